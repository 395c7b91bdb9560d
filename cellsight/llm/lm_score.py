"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every context (the word before, or the start of the text) is a restaurant
whose customers are the words that follow it. All context restaurants share
one parent, whose customers are their tables, over a uniform base of all
known words and one unknown. The seating is sampled by Gibbs sweeps: the
customers of one word in one restaurant leave it, their tables leave the
parent, and they are seated again one by one given everybody else; the
parent's customers likewise. Within a sweep all words of all restaurants do
so at once, given the others as of the sweep before. From the 256th customer
of a word on, customers come in groups of 1/128 of those seated, and a
binomial draw says how many of a group open tables. A text's probability is
the product of its tokens' predictive probabilities, each averaged over the
sweeps after burn-in.

How it is spread: documents stand in chunks of bounded size, as the word
numbers of their tokens, and stay there. Each chunk sends its distinct pairs
to shards, by a hash of the context (of the ``CONTEXTS`` most frequent words,
by context and word), which add up their counts. A pair that occurs once
always has one table, so only the other pairs take part in the sweeps. Words
stand in homes by a hash. Per sweep, shards tell each home the tables of its
words, as words and as contexts; homes add them up, seat the parent's
customers and answer. In the end every chunk asks the homes for its words'
sums after each sweep, and the shards for one number for each of its pairs;
chunks do so in rounds, as these answers are larger than all that is kept.
All draws are hashes of word, context and sweep, so a lost task repeats them.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, and one end. The
start of a text, as a context, has the end's key: an end is no other context.

Defined results: null or empty text has the end token only; a null id counts
as the empty text for the fold; without training documents every probability
is that of the base; repeated rows get equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm._common import arrow_rows, delete, fold, mix64, release_shuffles, small_batches, texts_of
from cellsight.session import materialize, scratch_path

CONTEXTS = 4096            # most frequent training words, whose followers are spread over the shards
SWEEPS = 12
BURN_IN = 2
DISCOUNT, STRENGTH = 0.75, 1.0              # of the context restaurants
PARENT_DISCOUNT, PARENT_STRENGTH = 0.5, 1.0
CHUNK_BYTES = 6 << 20      # text of the documents that are packed together
SHARD_TOKENS = 4_000_000   # training tokens a shard is meant to hold
MIN_SHARDS = 32
GROUP = 128                # customers of a word come in groups of this part of those seated, one at least
SEAT_ROWS = 100_000        # rows of a record batch that homes are made from
SEAT_BLOCK = 1 << 14       # restaurants' words seated together, few enough for a core's cache
ROUNDS = 4                 # parts of the chunks that are scored one after the other

if TaskContext.get():
    gc.freeze()            # a worker collects garbage after every task: it need not walk all loaded modules again


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _pack(**arrays) -> bytes:
    """Counts and positions are packed in their narrowest type, hashes (uint64) and floats as they are."""
    small = {k: _narrow(v) if isinstance(v, np.ndarray) and v.dtype.kind in "iu" and v.dtype != np.uint64 else v
             for k, v in arrays.items()}
    return zstandard.compress(pickle.dumps(small, protocol=5), 1)


def _unpack(blob) -> dict:
    return pickle.loads(zstandard.decompress(blob))


def _row(**columns: pa.Array) -> pa.RecordBatch:
    """One row; every column is an array of one value, or of the items of one list."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if isinstance(v, pa.Array) else pa.array([v])
             for v in columns.values()]
    return pa.RecordBatch.from_arrays(lists, list(columns))


# ---- chunks -----------------------------------------------------------------


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a chunk's words, the word number of every token (ends are number 0), and each text's tokens."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()).combine_chunks(), "")))
    some = pc.greater(pc.binary_length(trimmed), 0)  # an empty text would be split into one empty word
    split = pc.ascii_split_whitespace(trimmed.filter(some))
    found = split.flatten().dictionary_encode()
    lengths = np.ones(len(trimmed), np.int64)
    lengths[some.to_numpy(zero_copy_only=False)] += pc.list_value_length(split).to_numpy()
    word, is_end = np.zeros(lengths.sum(), np.uint32), np.zeros(lengths.sum(), bool)
    is_end[np.cumsum(lengths) - 1] = True
    word[~is_end] = found.indices.to_numpy() + 1
    words = [b"", *found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), word, lengths


def chunk_tokens(rows: DataFrame) -> DataFrame:
    """One row per chunk of documents: ids, fold, tokens, and the chunk's words (hashes, as they lie in memory) with
    their training counts.

    ``rows`` are (doc_id, held_out, body).
    """
    def pack(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        held = table["held_out"].combine_chunks()
        h, word, lengths = _tokens(table["body"])
        train = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), lengths)
        counts = np.bincount(word[train], minlength=len(h))
        pa.default_memory_pool().release_unused()  # Arrow would keep what its split texts took
        return _row(chunk=number, ids=table["doc_id"].combine_chunks(), held=held, tokens=_pack(word=word, lengths=lengths),
                    words=h.tobytes(), counts=_pack(counts=counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in small_batches(batches, CHUNK_BYTES):
            parts.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield pack(number, parts)
                number, parts, size = number + 1, [], 0
        if parts:
            yield pack(number, parts)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, held array<boolean>, tokens binary, "
                                "words binary, counts binary")


def _pairs(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and context number of a chunk's distinct pairs, and the pair of every token."""
    ctx = np.zeros(len(word), np.int64)
    ctx[1:] = word[:-1]  # after an end, which is number 0, a text starts
    pair, index = np.unique(word.astype(np.int64) << 32 | ctx, return_inverse=True)
    return pair >> 32, pair & 0xFFFFFFFF, index


def _shards(h: np.ndarray, word: np.ndarray, ctx: np.ndarray, head: np.ndarray, shards: int) -> np.ndarray:
    spread = mix64(h)[ctx]
    often = np.isin(h, head)[ctx]
    with np.errstate(over="ignore"):
        spread[often] = mix64(h[ctx[often]] + mix64(h[word[often]]))
    return (spread % np.uint64(shards)).astype(np.int64)


def _parts(of: np.ndarray, count: int) -> list[tuple[int, np.ndarray]]:
    """(number, positions) of the parts that positions belong to by number, below ``count``; both ascending."""
    order = np.argsort(of.astype(np.min_scalar_type(count)), kind="stable")
    sizes = np.bincount(of, minlength=count)
    ends = np.cumsum(sizes)
    return [(int(x), order[ends[x] - sizes[x]:ends[x]]) for x in np.flatnonzero(sizes)]


# ---- pair counts ------------------------------------------------------------

SHARD_SCHEMA = "shard int, blob binary, codes array<struct<chunk:long,blob:binary>>, ones binary"


def count_pairs(chunks: DataFrame, head: np.ndarray, shards: int) -> tuple[DataFrame, str]:
    """Pairs that occur more than once, one row per shard (and the table's folder): their state, which is word w and
    context c (positions in the hashes h), training count n, tables t (one each at first) and their total over sweeps.

    Beside them: how many pairs occur once, by word (one_w) and context (one_c) with hash h, and for the pairs of each chunk
    a code each: 0 not in training, 1 once, 2 + position among the shard's pairs.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(head)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, held, blob, words = (batch.column(i)[row] for i in range(4))
                p = _unpack(blob.as_py())
                h = np.frombuffer(words.as_py(), np.uint64)
                word, ctx, index = _pairs(p["word"])
                train = np.repeat(~held.values.to_numpy(zero_copy_only=False).astype(bool), p["lengths"])
                n = np.bincount(index[train], minlength=len(word)).astype(np.uint32)
                found, blobs = [], []
                for s, at in _parts(_shards(h, word, ctx, shared.value, shards), shards):
                    first = np.flatnonzero(np.diff(word[at], prepend=-1))
                    contexts, c = np.unique(ctx[at], return_inverse=True)
                    found.append(s)
                    blobs.append(_pack(w=h[word[at[first]]], runs=np.diff(first, append=len(at)), contexts=h[contexts], c=c, n=n[at]))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([chunk.as_py()] * len(found), pa.int64()),
                                                  pa.array(blobs, pa.binary())], ["shard", "chunk", "blob"])

    def add_up(table: pa.Table) -> pa.Table:
        chunk = table["chunk"].to_numpy()
        order = np.argsort(chunk)
        parts = [_unpack(table["blob"][int(i)].as_buffer()) for i in order]
        words, w = np.unique(np.concatenate([p.pop("w") for p in parts]), return_inverse=True)
        w = np.repeat(w.astype(np.uint32), np.concatenate([p.pop("runs") for p in parts]))
        contexts, place = np.unique(np.concatenate([p["contexts"] for p in parts]), return_inverse=True)
        starts, place = np.cumsum([0, *(len(p.pop("contexts")) for p in parts)]), place.astype(np.uint32)
        ends = np.cumsum([len(p["c"]) for p in parts])
        c = np.concatenate([place[start:][p.pop("c")] for p, start in zip(parts, starts[:-1], strict=True)])
        key = w.astype(np.int64)
        key *= len(contexts)
        key += c
        del w, c
        pair, index = np.unique(key, return_inverse=True)
        del key
        w, c = pair // len(contexts), pair % len(contexts)
        n = np.bincount(index, weights=np.concatenate([p["n"] for p in parts])).astype(np.int64)
        often, once = np.flatnonzero(n > 1), n == 1
        often = often[np.argsort(-n[often], kind="stable")]  # as they are seated
        code = np.minimum(n, 1).astype(np.uint32)
        code[often] = 2 + np.arange(len(often))
        codes = [_pack(code=x) for x in np.split(code[index], ends[:-1])]
        sums = np.bincount(w[once], minlength=len(words)), np.bincount(c[once], minlength=len(contexts))
        at = [np.flatnonzero(x) for x in sums]
        none = [np.zeros(len(x), np.int64) for x in at]
        ones = dict(h=np.concatenate([words[at[0]], contexts[at[1]]]),
                    one_w=np.concatenate([sums[0][at[0]], none[1]]), one_c=np.concatenate([none[0], sums[1][at[1]]]))
        h, place = np.unique(np.concatenate([words[w[often]], contexts[c[often]]]), return_inverse=True)
        place = place.astype(np.uint32)
        state = dict(h=h, w=place[:len(often)], c=place[len(often):], n=n[often], t=np.ones(len(often), np.int64),
                     total=np.zeros(len(often), np.int64))
        both = pa.StructArray.from_arrays([pa.array(chunk[order], pa.int64()), pa.array(codes, pa.binary())],
                                          ["chunk", "blob"])
        out = _row(shard=table["shard"][0].as_py(), blob=_pack(**state), codes=both, ones=_pack(**ones))
        return pa.Table.from_batches([out.set_column(0, "shard", out.column(0).cast(pa.int32()))])

    with arrow_rows(chunks.sparkSession, 1):
        sent = chunks.select("chunk", "held", "tokens", "words").mapInArrow(split, "shard int, chunk long, blob binary")
        return _keep(sent.groupBy("shard").applyInArrow(add_up, SHARD_SCHEMA), "lm-shards")


# ---- seating ----------------------------------------------------------------


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    h = mix64(key + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _binomial(size: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial draws from two uniforms each: the quantile, or beyond a mean of 32 on both sides the normal one."""
    q = np.minimum(p, 1 - p)
    mean = size * q
    x, wide = np.zeros(len(q)), np.flatnonzero(mean > 32)
    if len(wide):
        m = mean[wide]
        z = np.sqrt(-2 * np.log(1 - u[wide])) * np.cos(2 * np.pi * v[wide])
        x[wide] = np.clip(np.floor(m + np.sqrt(m * (1 - q[wide])) * z + 0.5), 0, size[wide])
    pmf = (1 - q) ** size
    at = np.flatnonzero((u > pmf) & (mean <= 32) & (size > 0))  # rows whose quantile is not reached yet
    u, pmf, n, q, k = u[at], pmf[at], size[at], q[at], 0
    odds, total = q / (1 - q), pmf.copy()
    while len(at):
        pmf = pmf * (n - k) / (k + 1) * odds
        k += 1
        total += pmf
        more = (u > total) & (n > k)
        if not (left := np.count_nonzero(more)):
            x[at] = k
            break
        if left < len(at):
            x[at[~more]] = k
            at, u, pmf, n, odds, total = (y[more] for y in (at, u, pmf, n, odds, total))
    return np.where(p > 0.5, size - x, x)


def seat(counts: np.ndarray, new: np.ndarray, discount: float, key: np.ndarray, sweep: int,
         grow: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables after seating ``counts`` customers of one dish each: a customer joins tables with weight
    (seated - discount * tables) and opens one with weight (new + grow * tables)."""
    tables = np.minimum(counts, 1).astype(np.float64)
    order = np.flatnonzero(counts > 1)
    order = order[np.argsort(-counts[order], kind="stable")]
    grow = np.broadcast_to(grow, len(counts))
    for start in range(0, len(order), SEAT_BLOCK):
        at = order[start:start + SEAT_BLOCK]
        tables[at] = _seat(counts[at], new[at], discount, key[at], sweep, grow[at])
    return tables


def _seat(left: np.ndarray, w: np.ndarray, discount: float, k: np.ndarray, sweep: int, g: np.ndarray) -> np.ndarray:
    """Tables of words with more than one customer, by falling number of customers."""
    t, falling = np.ones(len(left)), -left
    seated, live = 1, len(left)
    while live:
        step = max(1, seated // GROUP)
        weight = w[:live] + g[:live] * t[:live]
        p = weight / (weight + seated - discount * t[:live])
        u = _uniform(k[:live], sweep << 48 | seated << 1)
        if step == 1:
            t[:live] += u < p
        else:
            size = np.minimum(step, left[:live] - seated)
            v = _uniform(k[:live], sweep << 48 | seated << 1 | 1) if step > 32 else u  # a mean beyond 32 needs it
            t[:live] += _binomial(size, p, u, v)
        seated += step
        live = int(np.searchsorted(falling, -seated, "left"))
    return t


@dataclass
class Sums:
    """What holds for all words: sizes, and the parent's customers and tables after each sweep."""

    tokens: int                 # training tokens
    words: int                  # distinct training tokens
    customers: list[int] = field(default_factory=list)
    tables: list[int] = field(default_factory=list)

    def base(self, sweep: int) -> float:
        """Weight of a word that has no customer at the parent."""
        return (PARENT_STRENGTH + PARENT_DISCOUNT * self.tables[sweep]) / (self.words + 1)

    def at_parent(self, customers: np.ndarray, tables: np.ndarray, sweep: int, gone: np.ndarray | int = 0) -> np.ndarray:
        """Probability of words with these customers and tables at the parent, without ``gone`` of its customers."""
        taken = np.maximum(customers - gone - PARENT_DISCOUNT * np.minimum(tables, customers - gone), 0)
        return (taken + self.base(sweep)) / (PARENT_STRENGTH + self.customers[sweep] - gone)


def _home(h: np.ndarray, homes: int) -> np.ndarray:
    return h.view(np.int64) % homes


def _rows(key: str, own: int, blob: bytes, others: str, messages: list[tuple[int, bytes]], **more: int) -> pa.Table:
    """The row of a shard or home itself, and its messages to others."""
    n = len(messages)
    return pa.table({key: pa.array([own] * (n + 1), pa.int32()), others: pa.array([None, *(m[0] for m in messages)], pa.int32()),
                     "blob": pa.array([blob, *(m[1] for m in messages)], pa.binary()),
                     **{k: pa.array([v] + [None] * n, pa.int64()) for k, v in more.items()}})


def _messages(p: dict, homes: int) -> list[tuple[int, bytes]]:
    """To each home: the tables that its words have in this shard, as words and as contexts."""
    by_w, by_c = (np.bincount(p[x], weights=p["t"], minlength=len(p["h"])).astype(np.int64) for x in ("w", "c"))
    return [(x, _pack(h=p["h"][at], by_w=by_w[at], by_c=by_c[at])) for x, at in _parts(_home(p["h"], homes), homes)]


def _first_home(table: pa.Table) -> pa.Table:
    h, c, one_w, one_c = (table[x].to_numpy() for x in ("h", "c", "one_w", "one_c"))
    order = np.argsort(h.view(np.uint64))
    blob = _pack(h=h.view(np.uint64)[order], c=c[order], one_w=one_w[order], one_c=one_c[order],
                 tables=np.zeros(len(h), np.int64), hist=[])
    return pa.table({"home": table["home"][:1].cast(pa.int32()), "blob": pa.array([blob], pa.binary())})


def _at_home(sums: Sums, sweep: int):
    """Group function (a home's words, the shards' messages) -> its words after ``sweep``, and answers to the shards."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _unpack(left["blob"][0].as_py())
        customers, room = p["one_w"].astype(np.int64), p["one_c"].astype(np.int64)
        asked = []
        for shard, blob in sorted(zip(right["shard"].to_pylist(), right["blob"].to_pylist(), strict=True)):
            m = _unpack(blob)
            at = np.searchsorted(p["h"], m["h"])
            customers[at] += m["by_w"]
            room[at] += m["by_c"]
            asked.append((shard, at))
        if sweep:
            grow = PARENT_DISCOUNT / (sums.words + 1)
            tables = seat(customers, sums.base(sweep - 1) - grow * p["tables"], PARENT_DISCOUNT, mix64(p["h"]), sweep, grow)
        else:
            tables = np.minimum(customers, 1)
        p["tables"] = tables = tables.astype(np.int64)
        if sweep > BURN_IN:
            p["hist"].append(_pack(x=np.stack([customers, tables, room])))  # packed once, until the last sweep
        if sweep == SWEEPS:
            p["hist"] = [_unpack(x)["x"] for x in p["hist"]]
        answers = [(shard, _pack(customers=customers[at], tables=tables[at], room=room[at])) for shard, at in asked]
        return _rows("home", left["home"][0].as_py(), _pack(**p), "shard", answers, customers=customers.sum(), tables=tables.sum())
    return run


def _reseat(sums: Sums, sweep: int, homes: int):
    """Group function (a shard's pairs, the homes' answers) -> its pairs after ``sweep``, each seated given all others
    after the sweep before, and messages to the homes."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _unpack(left["blob"][0].as_py())
        at, told = dict(_parts(_home(p["h"], homes), homes)), {x: np.zeros(len(p["h"])) for x in ("customers", "tables", "room")}
        for x, blob in zip(right["home"].to_pylist(), right["blob"].to_pylist(), strict=True):
            for name, values in _unpack(blob).items():
                told[name][at[x]] = values
        own = p["t"].astype(np.float64)
        word = sums.at_parent(told["customers"][p["w"]], told["tables"][p["w"]], sweep - 1, own)
        new = (STRENGTH + DISCOUNT * (told["room"][p["c"]] - own)) * word
        with np.errstate(over="ignore"):
            key = mix64(mix64(p["h"])[p["w"]] + p["h"][p["c"]])
        p["t"] = seat(p["n"].astype(np.int64), new, DISCOUNT, key, sweep, DISCOUNT * word).astype(np.int64)
        if sweep > BURN_IN:
            p["total"] = p["total"] + p["t"]  # t is wide here, so the sum is
        return _rows("shard", left["shard"][0].as_py(), _pack(**p), "home", _messages(p, homes))
    return run


def sample(shards: DataFrame, counts: DataFrame, sums: Sums, homes: int) -> tuple[DataFrame, DataFrame]:
    """Run the sweeps; ``counts`` are (h, c), the words' training counts.

    Returns the shards' pairs (shard, blob), with their tables added up over the sweeps after burn-in, and the homes
    of the words (home, blob): hash, training count, and hist, which is customers and tables at the parent and tables
    as a context after each of those sweeps.
    """
    spark = shards.sparkSession

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in map(_unpack, texts_of(batch, "ones")):
                yield pa.RecordBatch.from_pydict({"h": p["h"].view(np.int64), **{x: p[x].astype(np.int64) for x in ("one_w", "one_c")}})

    once = shards.select("ones").mapInArrow(flat, "h long, one_w long, one_c long")
    words = (counts.unionByName(once, allowMissingColumns=True).groupBy(F.pmod("h", F.lit(homes)).cast("int").alias("home"), "h")
             .agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c", "one_w", "one_c"))))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(texts_of(batch, "shard"), texts_of(batch, "blob"), strict=True):
                yield from _rows("shard", shard, blob, "home", _messages(_unpack(blob), homes)).to_batches()

    kinds = "shard int, home int, blob binary", "home int, shard int, blob binary, customers long, tables long"
    with arrow_rows(spark, 1):
        told, told_path = _keep(shards.select("shard", "blob").mapInArrow(tell, kinds[0]), "lm-pairs")
    old: list[str] = []
    with arrow_rows(spark, SEAT_ROWS):
        home = words.groupBy("home").applyInArrow(_first_home, "home int, blob binary")
        for sweep in range(SWEEPS + 1):
            sent = told.where("home IS NOT NULL").groupBy("home")
            answers, path = _keep(home.groupBy("home").cogroup(sent).applyInArrow(_at_home(sums, sweep), kinds[1]), "lm-homes")
            total = answers.agg(F.sum("customers").alias("k"), F.sum("tables").alias("t")).first()
            sums.customers.append(total["k"] or 0)
            sums.tables.append(total["t"] or 0)
            home = answers.where("shard IS NULL").select("home", "blob")
            for x in old:
                delete(spark, x)
            old = [path]
            if sweep < SWEEPS:
                pairs = told.where("home IS NULL").select("shard", "blob").groupBy("shard")
                back = answers.where("shard IS NOT NULL").select("shard", "home", "blob").groupBy("shard")
                old.append(told_path)
                told, told_path = _keep(pairs.cogroup(back).applyInArrow(_reseat(sums, sweep + 1, homes), kinds[0]), "lm-pairs")
            release_shuffles(spark)
    return told.where("home IS NULL").select("shard", "blob"), home


def _keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table written to a folder of its own and read back, and the folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "none").parquet(path)  # nearly all of it is packed already
    return df.sparkSession.read.parquet(path), path


# ---- scores -----------------------------------------------------------------


def _round(chunk, rounds: int):
    """The round of a chunk, from the two halves of its number."""
    return ((chunk >> 32) + chunk) % rounds


def seated_mass(pairs: DataFrame, shards: DataFrame, rounds: int = 1, own: int = 0) -> DataFrame:
    """(chunk, shard, blob): for the pairs that a chunk of this round has in a shard, n - discount * tables, averaged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, state, codes in zip(*(texts_of(batch, c) for c in ("shard", "blob", "codes")), strict=True):
                codes = [x for x in codes if _round(x["chunk"], rounds) == own]
                if not codes:
                    continue
                p = _unpack(state)
                mass = np.concatenate([[0, 1 - DISCOUNT], p["n"] - DISCOUNT * p["total"] / (SWEEPS - BURN_IN)])
                blobs = [_pack(mass=mass[_unpack(x["blob"])["code"]]) for x in codes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["chunk"] for x in codes], pa.int64()), pa.array([shard] * len(codes), pa.int32()),
                     pa.array(blobs, pa.binary())], ["chunk", "shard", "blob"])

    return pairs.join(shards.select("shard", "codes"), "shard").mapInArrow(
        run, "chunk long, shard int, blob binary")


def predictive(word: np.ndarray, ctx: np.ndarray, mass: np.ndarray, counts: np.ndarray, hist: np.ndarray,
               sums: Sums) -> np.ndarray:
    """Probability of words after contexts, averaged over the sweeps after burn-in.

    ``counts`` and ``hist`` (sweep, 3, word) belong to the words that ``word`` and ``ctx`` number.
    """
    total = np.zeros(len(word))
    for i, (customers, tables, room) in enumerate(hist):
        p = sums.at_parent(customers, tables, BURN_IN + 1 + i)
        total += (STRENGTH + DISCOUNT * room)[ctx] * p[word]
    return (mass + total / len(hist)) / (STRENGTH + counts)[ctx]


def ask_homes(chunks: DataFrame, home: DataFrame, homes: int) -> tuple[DataFrame, str]:
    """(chunk, home, told): training counts and histories of a chunk's words, in their order among those of the home;
    and the table's folder."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h = np.frombuffer(batch.column(1)[row].as_py(), np.uint64)
                found = _parts(_home(h, homes), homes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.int32()), pa.array([batch.column(0)[row].as_py()] * len(found), pa.int64()),
                     pa.array([_pack(h=h[at]) for _, at in found], pa.binary())], ["home", "chunk", "asked"])

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = SWEEPS - BURN_IN
        p = _unpack(left["blob"][0].as_py()) if len(left) else {
            "h": np.empty(0, np.uint64), "c": np.empty(0, np.int64), "hist": [np.empty((3, 0), np.int64)] * kept}
        n = len(p["h"])
        # a row per word, the last for unknown words; most fit into bytes
        hist = np.ascontiguousarray(np.concatenate([p["c"][None], *p["hist"]]).T)
        hist = np.concatenate([hist, np.zeros((1, hist.shape[1]), hist.dtype)])
        large = hist.max(axis=1) > 255
        small = hist.astype(np.uint8)  # only read where not large
        out = []
        for blob in right["asked"].to_pylist():
            h = _unpack(blob)["h"]
            at = np.searchsorted(p["h"], h)
            at[at == n] = 0
            at = np.where(p["h"][at] == h, at, n) if n else np.zeros(len(h), np.int64)
            big = large[at]
            out.append(_pack(large=big, small=small[at[~big]], wide=hist[at[big]]))
        return pa.table({"chunk": right["chunk"], "home": right["home"], "told": pa.array(out, pa.binary())})

    with arrow_rows(chunks.sparkSession, 1):
        asked = chunks.select("chunk", "words").mapInArrow(ask, "home int, chunk long, asked binary")
        return _keep(home.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(
            tell, "chunk long, home int, told binary"), "lm-told")


def score_chunks(chunks: DataFrame, told: DataFrame, masses: DataFrame, head: np.ndarray, shards: int,
                 sums: Sums) -> DataFrame:
    """The scores of every document, from its chunk, what the homes told of its words, and its pairs' masses."""
    shared = chunks.sparkSession.sparkContext.broadcast(head)
    kind = chunks.schema["ids"].dataType.elementType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(table["tokens"].is_valid())
        ids, held = (own[c].combine_chunks().flatten() for c in ("ids", "held"))
        h = np.frombuffer(own["words"][0].as_py(), np.uint64)
        p = _unpack(own["tokens"][0].as_py())
        home = dict(_parts(_home(h, shards), shards))
        rows = table.filter(table["told"].is_valid())
        heard = [(home[x], _unpack(blob)) for x, blob in zip(rows["home"].to_pylist(), rows["told"].to_pylist(), strict=True)]
        found = np.empty((len(h), 1 + 3 * (SWEEPS - BURN_IN)), np.result_type(np.uint8, *(m["wide"] for _, m in heard)))
        for at, m in heard:
            found[at[~m["large"]]], found[at[m["large"]]] = m["small"], m["wide"]
        counts, hist = found[:, 0].astype(np.int64), np.ascontiguousarray(found[:, 1:].T, np.float64).reshape(-1, 3, len(h))
        word, ctx, index = _pairs(p["word"])
        rows = table.filter(table["blob"].is_valid())
        blobs = sorted(zip(rows["shard"].to_pylist(), rows["blob"].to_pylist(), strict=True))
        mass = np.empty(len(word))
        parts = _parts(_shards(h, word, ctx, shared.value, shards), shards)
        for (_, at), (_, b) in zip(parts, blobs, strict=True):
            mass[at] = _unpack(b)["mass"]
        value = np.log10(predictive(word, ctx, mass, counts, hist, sums))
        base = np.log10((counts + 0.5) / (sums.tokens + 0.5 * (sums.words + 1)))
        lengths = p["lengths"].astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        n = len(starts)
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": pa.array(lengths),
                         "n_known": pa.array(np.add.reduceat((counts > 0)[p["word"]].astype(np.int64), starts)),
                         "train_tokens": pa.array(np.full(n, sums.tokens, np.int64)),
                         "base_score": pa.array(np.add.reduceat(base[p["word"]], starts)),
                         "score": pa.array(np.add.reduceat(value[index], starts))})

    rows = (chunks.select("chunk", "ids", "held", "tokens", "words").unionByName(masses, allowMissingColumns=True)
            .unionByName(told, allowMissingColumns=True))
    return rows.groupBy("chunk").applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
             "score double")


def count_words(chunks: DataFrame) -> tuple[DataFrame, Sums, np.ndarray]:
    """Training counts (h, c) of the words, their sums, and the hashes of the most frequent ones, ascending."""
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, blob in zip(texts_of(batch, "words"), texts_of(batch, "counts"), strict=True):
                h, c = np.frombuffer(h, np.int64), _unpack(blob)["counts"].astype(np.int64)
                yield pa.RecordBatch.from_pydict({"h": h[c > 0], "c": c[c > 0]})

    with arrow_rows(chunks.sparkSession, 1):
        counts = materialize(chunks.select("words", "counts").mapInArrow(flat, "h long, c long")
                             .groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")
    size = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = [r["h"] & 0xFFFFFFFFFFFFFFFF for r in counts.orderBy(F.col("c").desc(), "h").limit(CONTEXTS).collect()]
    return counts, Sums(size["n"] or 0, size["v"]), np.sort(np.array(head, np.uint64))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", test_fold: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == test_fold).alias("held_out"),
                       F.col(text_col).alias("body"))
    chunks = materialize(chunk_tokens(rows), "lm-chunks")
    counts, sums, head = count_words(chunks)
    shard_count = max(MIN_SHARDS, ceil(sums.tokens / SHARD_TOKENS))
    shards, path = count_pairs(chunks, head, shard_count)
    release_shuffles(docs.sparkSession)
    pairs, home = sample(shards, counts, sums, shard_count)
    rounds = max(1, min(ROUNDS, chunks.count()))
    scores = []
    for r in range(rounds):
        part = chunks.where(F.pmod(F.shiftright("chunk", 32) + F.col("chunk"), F.lit(rounds)) == r)
        with arrow_rows(docs.sparkSession, 1):
            masses, masses_path = _keep(seated_mass(pairs, shards, rounds, r), "lm-masses")
        told, told_path = ask_homes(part, home, shard_count)
        release_shuffles(docs.sparkSession)
        scores.append(materialize(score_chunks(part, told, masses, head, shard_count, sums), "lm-scores"))
        for x in (masses_path, told_path):
            delete(docs.sparkSession, x)
        release_shuffles(docs.sparkSession)
    delete(docs.sparkSession, path)
    return reduce(DataFrame.unionByName, scores)


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) of scored documents, per token."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"))
