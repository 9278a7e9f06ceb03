r"""Phrase collocations by mergeable Misra-Gries summaries.

Every frequent phrase has frequent words and frequent shorter phrases inside.  Words, then phrases of two frequent
words, then those of three and more in runs of surviving pairs go into Misra-Gries summaries, one per hash
partition.  A summary of c counters that has given up u on each misses at most u occurrences of any
phrase, and u < mass / c; c exceeds twice the partition's mass over the threshold.
Summaries of tasks merge in the partition; what may still reach the threshold survives, so no frequent phrase
is lost.  The bound u is carried and checked: if one partition reached the threshold (unevenly dealt
mass), the pass runs again with twice the counters.  A last pass counts the survivors exactly, as text.

What is known of one pass reaches the next as a bitmap of fixed size over hashes: it only spares work, a false
bit is a phrase counted in vain.  Summaries know a phrase by 30 to 40 bits of its hash (64 values an occurrence), which may at worst let one more
survive; the exact count goes by the text (inside one task, by 64 bits of hash).

Defined results: null texts have no words, a null lang is ``und``; repeated rows count each; equal scores
and counts rank by the phrase's bytes; an empty table gives an empty result.  Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .exchange import block_of, n_blocks, text_bytes
from .textops import LOWER, flat, mask_runs, mix, ranges, run_starts, slices, span_hash, string_array

MAX_WORDS = 5
THRESHOLD = 100
COVER = 100                      # per cent
TOP = 2000
BLOCK_MASS = 4_000_000           # occurrences of one hash partition
MERGE = 1 << 19                  # entries waiting to be merged into a summary
EMIT = 1 << 21                   # entries of a task's summaries before they are sent
WORD_BITS, PHRASE_BITS = 23, 26  # bitmaps of 1 and 8 MB
RANK_ROWS = 200_000
SLICE = 1 << 20
ZSTD = pa.Codec("zstd")

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)


def spare_bits(mass: int) -> np.uint64:
    """Hash bits that summaries do without: with 64 cells an occurrence few rare phrases share one."""
    return np.uint64(64 - min(40, max(30, int(mass).bit_length() + 6)))


# ------------------------------------------------------------ words and phrases of a slice

class Slice:
    """Words of a slice of rows: byte spans, language, piece, hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: list):
        self.low = LOWER[data]
        cut = _BREAK[self.low]
        self.s, self.e, row = mask_runs(~(cut | _BLANK[self.low]), offs)
        acc = np.zeros(len(data) + 1, np.int64)
        np.cumsum(cut, out=acc[1:])
        self.piece = acc[self.s] + row                        # both only grow: equal in one piece of one row
        self.names, code = np.unique(np.array(["und" if x is None else x for x in langs], dtype=object), return_inverse=True) if langs else ([], np.zeros(0, np.int64))
        self.lang = code[row]
        raw = [n.encode() for n in self.names]
        flat_names = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum([len(r) for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
        seed = self.seed = span_hash(flat_names, end - np.array([len(r) for r in raw], np.int64), end)
        self.word = span_hash(self.low, self.s, self.e)
        self.first = mix(self.word + seed[self.lang] * _STEP) if len(row) else self.word

    def hashes(self, most: int):
        """(size, hash, whole): hash of the phrase that begins at each word, and whether it lies in one piece."""
        h, n = self.first, len(self.first)
        yield 1, h, np.ones(n, bool)
        for m in range(2, most + 1):
            if n < m:
                return
            h = mix(h[:n - m + 1] * _STEP + self.word[m - 1:])
            yield m, h, self.piece[:n - m + 1] == self.piece[m - 1:]

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words joined by single blanks, and where each begins and ends."""
        size = self.e - self.s
        start = np.cumsum(size + 1) - (size + 1)
        out = np.full(int((size + 1).sum()), 0x20, np.uint8)
        out[np.repeat(start, size) + ranges(size)] = self.low[np.repeat(self.s, size) + ranges(size)]
        return out, start, start + size


def read_slices(batches, limit: int):
    """Slices of batches of (text, lang)."""
    for b in batches:
        data, offs = flat(b.column(0))
        langs = b.column(1).to_pylist()
        for i, j in slices(offs, limit):
            yield Slice(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], langs[i:j])


def counted(h: np.ndarray, *at: np.ndarray):
    """Distinct hashes, their counts and one place of each."""
    order = np.argsort(h, kind="stable")
    first = run_starts(h[order])
    return h[order[first]], np.diff(np.append(first, len(order))), order[first]


def set_in(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Whether the hashes' bits are set; no bitmap lets all pass."""
    if bits is None:
        return np.ones(len(h), bool)
    place = h >> np.uint64(64 - int(math.log2(len(bits) * 8)))
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` over the upper bits of column ``h``: its size does not follow the data."""
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts:
        out[(r.part - 1) * 4096:r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


# ------------------------------------------------------------ Misra-Gries

@dataclass
class Summary:
    """Counters by hash, sorted, for all hash partitions of a task; ``lost`` and ``mass`` by partition."""
    blocks: int
    capacity: int
    h: np.ndarray
    n: np.ndarray
    lost: np.ndarray
    mass: np.ndarray
    spare: np.uint64 = np.uint64(24)

    @classmethod
    def empty(cls, blocks: int, capacity: int, spare: np.uint64 = np.uint64(24)) -> "Summary":
        return cls(blocks, capacity, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(blocks, np.int64), np.zeros(blocks, np.int64), spare)

    def add(self, hs: list[np.ndarray], ns: list[np.ndarray]) -> None:
        """Merges sorted runs of counters and trims every partition to its capacity."""
        h, n = np.concatenate([self.h, *hs]), np.concatenate([self.n, *ns])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = run_starts(h)
        self.h, self.n = h[first], np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        self._trim()

    def _trim(self) -> None:
        cut = np.searchsorted(block_of(self.h, self.blocks), np.arange(self.blocks + 1))
        over = np.flatnonzero(np.diff(cut) > self.capacity)
        if len(over) == 0:
            return
        for b in over.tolist():
            part = self.n[cut[b]:cut[b + 1]]
            k = len(part) - self.capacity - 1
            give = int(np.partition(part, k)[k])              # the largest counter that finds no room
            part -= give
            self.lost[b] += give
        keep = self.n > 0
        self.h, self.n = self.h[keep], self.n[keep]

    def rows(self) -> pa.RecordBatch:
        cut = np.searchsorted(block_of(self.h, self.blocks), np.arange(self.blocks + 1))
        used = np.flatnonzero((np.diff(cut) > 0) | (self.mass > 0))
        payload = [to_bytes(self.h[cut[b]:cut[b + 1]], self.n[cut[b]:cut[b + 1]], self.spare) for b in used.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(self.lost[used]), pa.array(self.mass[used]), pa.array(payload, pa.binary())],
                                          names=["block", "lost", "mass", "payload"])


def to_bytes(h: np.ndarray, n: np.ndarray, spare: np.uint64) -> bytes:
    """Sorted hashes of at most 40 bits as gaps, and counts, byte by byte: high bytes are few and compress well."""
    gaps = np.diff(h >> spare, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return len(h).to_bytes(8, "little") + ZSTD.compress(gaps.T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def from_bytes(raw: bytes, spare: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(ZSTD.decompress(raw[8:], 9 * size), np.uint8).reshape(9, size)
    gaps, n = np.zeros((size, 8), np.uint8), np.ascontiguousarray(planes[5:].T)
    gaps[:, :5] = planes[:5].T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64) << spare, n.view("<u4").ravel().astype(np.int64)


def wanted_places(part: Slice, sizes: range, words, pairs):
    """(size, hash, places): phrases whose words and pairs may be frequent."""
    ok = None
    for m, h, whole in part.hashes(sizes.stop - 1):
        if m == 1:
            good = inside = set_in(words.value if words else None, h)
        elif m == 2:
            ok = whole & good[:-1] & good[1:]
            if pairs is not None:
                ok &= set_in(pairs.value, h)
            inside = ok
        else:
            inside = inside[:len(h)] & ok[m - 2:]
        if m in sizes:
            yield m, h, np.flatnonzero(inside)


def _summarise(sizes: range, blocks: int, capacity: int, spare: np.uint64, words, pairs):
    def run(batches):
        total = Summary.empty(blocks, capacity, spare)
        hs, ns, waiting = [], [], 0
        for part in read_slices(batches, SLICE):
            for _, h, at in wanted_places(part, sizes, words, pairs):
                h = h[at] >> spare << spare
                d, n, _ = counted(h)
                hs.append(d)
                ns.append(n)
                waiting += len(d)
                total.mass += np.bincount(block_of(h, blocks), minlength=blocks)
            if waiting >= MERGE:
                total.add(hs, ns)
                hs, ns, waiting = [], [], 0
                if len(total.h) >= EMIT:
                    yield total.rows()
                    total = Summary.empty(blocks, capacity, spare)
        total.add(hs, ns)
        yield total.rows()
    return run


def _merge(capacity: int, threshold: int, spare: np.uint64):
    """All summaries of one partition in one: what may reach the threshold, and a row with the bound."""
    def run(key, table):
        total = Summary.empty(1, capacity)
        hs, ns, waiting = [], [], 0
        for raw in table.column("payload"):
            h, n = from_bytes(raw.as_py(), spare)
            hs.append(h)
            ns.append(n)
            waiting += len(h)
            if waiting >= MERGE:
                total.add(hs, ns)
                hs, ns, waiting = [], [], 0
        total.add(hs, ns)
        lost = int(total.lost[0]) + sum(table.column("lost").to_pylist())
        may = total.h[total.n + lost >= threshold].view(np.int64)
        return pa.table({"h": pa.concat_arrays([pa.array(may, pa.int64()), pa.array([None], pa.int64())]),
                         "lost": pa.array(np.full(len(may) + 1, lost, np.int64)),
                         "mass": pa.array(np.full(len(may) + 1, sum(table.column("mass").to_pylist()), np.int64))})
    return run


def survivors(texts: DataFrame, sizes: range, mass: int, threshold: int, words=None, pairs=None, block_mass: int = BLOCK_MASS, room: float = 2.0) -> tuple[DataFrame, int]:
    """(``h``: hashes of a superset of the phrases with ``threshold`` occurrences, occurrences seen).  ``mass`` estimates the occurrences."""
    blocks = n_blocks(max(1, mass), block_mass)
    spare = spare_bits(mass)
    while True:
        capacity = int(room * mass / blocks / threshold) + 16
        found = texts.mapInArrow(_summarise(sizes, blocks, capacity, spare, words, pairs), "block long, lost long, mass long, payload binary") \
            .groupBy("block").applyInArrow(_merge(capacity, threshold, spare), "h long, lost long, mass long")
        found = cut_lineage(found)
        bound, seen = found.filter("h is null").agg(F.max("lost"), F.sum("mass")).first()
        if (bound or 0) < threshold:
            return found.filter("h is not null").select("h"), seen or 0
        room *= 2


# ------------------------------------------------------------ exact counts

class Counts:
    """Exact counts of a task, by hash, with one text each; sent by hash partition."""

    def __init__(self, blocks: int):
        self.blocks, self.waiting, self.parts = blocks, 0, []

    def add(self, h, n, m, lang, phrase) -> None:
        self.parts.append((h, n, m, lang, phrase))
        self.waiting += len(h)

    def merge(self) -> int:
        h, n, m = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        lang, phrase = (pa.concat_arrays([p[k] for p in self.parts]) for k in (3, 4))
        order = np.argsort(h, kind="stable")
        first = run_starts(h[order])
        one = pa.array(order[first])
        self.parts = [(h[order[first]], np.add.reduceat(n[order], first), m[order[first]], lang.take(one), phrase.take(one))] if len(first) else []
        self.waiting = 0
        return len(first)

    def rows(self):
        if not self.parts or not self.merge():
            return
        (h, n, m, lang, phrase), = self.parts
        cut = np.searchsorted(block_of(h, self.blocks), np.arange(self.blocks + 1)).tolist()
        batch = pa.RecordBatch.from_arrays([lang, phrase, pa.array(m), pa.array(n)], names=["lang", "phrase", "m", "n"])
        used = [b for b in range(self.blocks) if cut[b] < cut[b + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([_ipc(batch.slice(cut[b], cut[b + 1] - cut[b])) for b in used], pa.binary())], names=["block", "payload"])
        self.parts = []


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _count_phrases(sizes: range, blocks: int, words, pairs, longer):
    def run(batches):
        total = Counts(blocks)
        for part in read_slices(batches, SLICE):
            names = pa.array(list(part.names), pa.string())
            # a row without a phrase holds the words of a language
            seed = part.seed >> np.uint64(1)
            total.add(seed, np.bincount(part.lang, minlength=len(names)), np.zeros(len(names), np.int32), names, pa.nulls(len(names), pa.string()))
            spaced, start, end = part.spaced()
            for m, h, at in wanted_places(part, sizes, words, pairs):
                if m > 2:
                    at = at[set_in(longer.value if longer else None, h[at])]
                h, n, k = counted(h[at])
                at = at[k]
                size = end[at + m - 1] - start[at]
                cut = np.concatenate([[0], np.cumsum(size)])
                text = spaced[np.repeat(start[at], size) + ranges(size)]
                total.add(h, n, np.full(len(at), m, np.int32), names.take(pa.array(part.lang[at])), string_array(text, cut).cast(pa.string()))
            if total.waiting >= MERGE and total.merge() >= MERGE:
                yield from total.rows()
        yield from total.rows()
    return run


def _sum_texts(threshold: int):
    """Exact sums of a hash partition, by text."""
    def run(key, table):
        got = pa.concat_tables([pa.ipc.open_stream(raw.as_py()).read_all() for raw in table.column("payload")])
        got = got.group_by(["lang", "phrase", "m"]).aggregate([("n", "sum")])
        keep = pc.or_(pc.greater_equal(got.column("n_sum"), threshold), pc.equal(got.column("m"), 0))
        got = got.filter(keep)
        return pa.table({"lang": got.column("lang"), "phrase": got.column("phrase"), "m": got.column("m"), "n": got.column("n_sum")})
    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, max_words: int = MAX_WORDS,
                  block_mass: int = BLOCK_MASS, room: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, m, n`` of all phrases of 1 to ``max_words`` words found ``threshold`` times or more, ``lang, total``)."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    # words are estimated at five bytes; the bound of the summaries is checked, not assumed
    found, mass = survivors(texts, range(1, 2), text_bytes(texts) // 5, threshold, block_mass=block_mass, room=room)
    frequent = sc.broadcast(bitmap(found, WORD_BITS))
    pairs = longer = None
    if max_words > 1:
        pairs = sc.broadcast(bitmap(survivors(texts, range(2, 3), mass, threshold, frequent, None, block_mass, room)[0], PHRASE_BITS))
    if max_words > 2:
        # of every longer size there are at most as many as words
        longer = sc.broadcast(bitmap(survivors(texts, range(3, max_words + 1), mass * (max_words - 2), threshold, frequent, pairs, block_mass, room)[0], PHRASE_BITS))
    blocks = n_blocks(max(1, mass), block_mass)
    counts = texts.mapInArrow(_count_phrases(range(1, max_words + 1), blocks, frequent, pairs, longer), "block long, payload binary") \
        .groupBy("block").applyInArrow(_sum_texts(threshold), "lang string, phrase string, m int, n long")
    counts = cut_lineage(counts)
    return counts.filter("m > 0"), counts.filter("m = 0").groupBy("lang").agg(F.sum("n").alias("total"))


# ------------------------------------------------------------ scores

# whole numbers of up to 38 digits: 1000 * a * n may pass 64 bits
SCORE = "cast((cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) * 1000) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as bigint)"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, max_words: int = MAX_WORDS, cover: int = COVER,
                 top: int | None = TOP, **params) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language (all with ``top=None``)."""
    counts, totals = phrase_counts(docs, text, lang, threshold, max_words, **params)
    found = counts.filter("m >= 2").withColumnRenamed("n", "a")
    # inside a longer candidate that is as frequent
    inner = F.expr("flatten(transform(sequence(1, m), i -> transform(filter(sequence(2, m - 1), q -> i + q - 1 <= m), "
                   "q -> array_join(slice(split(phrase, ' '), i, q), ' '))))")
    covered = found.filter("m >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    left = found.join(covered, ["lang", "phrase"], "left").filter(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a"))).drop("over")
    cuts = left.select("lang", "phrase", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")) \
        .withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - m)"))
    part = counts.select("lang", "phrase", "n")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]) \
        .join(part.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"]).join(totals.withColumnRenamed("total", "n"), "lang")
    best = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")) \
        .select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    by_lang = Window.partitionBy("lang").orderBy(*order)
    if top is None:
        return best
    # the first of every share of a language, then of the language
    best = cut_lineage(best)
    shares = n_blocks(max(1, best.count()), RANK_ROWS)
    share = Window.partitionBy("lang", "share").orderBy(*order)
    best = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares))).withColumn("at", F.row_number().over(share)).filter(F.col("at") <= top)
    return best.withColumn("rank", F.row_number().over(by_lang).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP11_SQL = r"""WITH
d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM d),
u AS (SELECT lang, piece, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
x AS (SELECT lang, w, lead(w, 1) OVER z AS w2, lead(w, 2) OVER z AS w3, lead(w, 3) OVER z AS w4, lead(w, 4) OVER z AS w5 FROM u WINDOW z AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS m, w AS phrase FROM x UNION ALL SELECT lang, 2, w || ' ' || w2 FROM x WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL
      UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL UNION ALL SELECT lang, 5, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM x WHERE w5 IS NOT NULL),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND a >= 100),
i AS (SELECT lang, a, unnest(flatten([[array_to_string(ws[x:x + q - 1], ' ') FOR x IN range(1, m - q + 2)] FOR q IN range(2, m)])) AS phrase FROM c WHERE m >= 3),
o AS (SELECT lang, phrase, max(a) AS over FROM i GROUP BY 1, 2),
s AS (SELECT c.lang, c.phrase, c.a, c.m, c.ws FROM c LEFT JOIN o USING (lang, phrase) WHERE o.over IS NULL OR 100 * o.over < 100 * c.a),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS h, array_to_string(ws[k + 1:], ' ') AS e FROM (SELECT *, unnest(range(1, m)) AS k FROM s)),
v AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, t.n, CAST((1000::HUGEINT * k.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.h JOIN f r ON r.lang = k.lang AND r.phrase = k.e JOIN t ON t.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS x FROM v),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE x = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000"""

QUERIES = {"op11_phrase_collocations": (op11_phrase_collocations, OP11_SQL)}
