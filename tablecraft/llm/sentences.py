"""Substring dedup by sliding sentence spans.

A sentence ends behind one of ``ENDERS`` before white space, or at a line feed;
clause marks are enders too, so a passage spliced into the middle of another
sentence still has whole sentences of its own.  Equal runs of consecutive sentences
meet in hash blocks; the one that comes first by (doc_id, position) stays, and
sentences covered by any other are removed from their texts.

Two rules say which runs are hashed.  ``op5_sentence_spans`` takes every run of
``RUN`` sentences with at least ``MIN_WORDS`` words, as its SQL does.
``op5_whole_spans`` (``run=None``) covers every run with at least ``MIN_WORDS``
words, whatever its number of sentences: for each sentence it takes the shortest
such run that begins with it and the shortest that ends with it, and any repeated
run is covered by those inside it.  Where the text ends before ``MIN_WORDS`` words,
its last sentences are a run if they are ``RUN`` or more.

A map task sends one entry per distinct run of a slice, so a run that stands in a
third of all documents costs its block one entry per slice.

Defined results: null and empty texts have no sentences; texts of fewer
sentences than a run lose nothing; a run repeated inside one text goes from its
second place on; fully repeated rows count as one text and get the same result; an
empty table gives an empty result.  Extra columns are kept, ``n_sentences``,
``n_removed`` and ``n_spans`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import block_of, first_of, n_blocks, pack, text_bytes, unpack
from .textops import edges, mix, named_back, numbered, quoted, run_starts, span_hash, text_slices

ENDERS = ".!?;:,"
RUN = 3
MIN_WORDS = 8
BLOCK_BYTES = 64 << 20

_END = np.zeros(256, bool)
_END[list(ENDERS.encode())] = True
_ROW = ["<i8", "u1", "<i8", "<u4"]          # doc_id, whether it is null, text digest, entries


def sentences(data: np.ndarray, offs: np.ndarray):
    """(start, end, row, words) of the sentences of all rows, from first to last word."""
    s, e, row = edges(data, offs)
    if len(s) == 0:
        return s, e, row, s
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    last = np.ones(len(s), bool)
    last[:-1] = _END[data[e[:-1] - 1]] | (lines[s[1:]] > lines[e[:-1]]) | (row[1:] != row[:-1])
    close = np.flatnonzero(last)
    open_ = np.concatenate([[0], close[:-1] + 1])
    return s[open_], e[close], row[close], close - open_ + 1


def runs(data: np.ndarray, offs: np.ndarray, run: int | None, min_words: int):
    """(hash, row, first sentence's number in its row, sentences) of the runs of ``run`` sentences, or of any number."""
    s, e, row, words = sentences(data, offs)
    begin = run_starts(row)
    size = np.diff(np.append(begin, len(row)))
    number = np.arange(len(row)) - np.repeat(begin, size)
    if len(s) < (run or 1):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    h = span_hash(data, s, e)
    total = np.concatenate([[0], np.cumsum(words)])
    if run:
        at = np.flatnonzero((row[run - 1:] == row[:len(row) - run + 1]) & (total[run:] - total[:-run] >= min_words))
        n = np.full(len(at), run)
    else:
        at, n = _shortest(total, np.repeat(begin, size), np.repeat(begin + size, size), min_words)
    key = np.zeros(len(at), np.uint64)
    for k in range(int(n.max(initial=0))):
        on = n > k
        key[on] = mix(key[on] * np.uint64(3) + h[at[on] + k])
    return key, row[at], number[at], n


def _shortest(total: np.ndarray, begin: np.ndarray, stop: np.ndarray, min_words: int):
    """(first sentence, sentences) of the shortest runs of ``min_words`` from and up to each sentence, and of short ends of texts."""
    i = np.arange(len(begin))
    to = np.searchsorted(total, total[:-1] + min_words)
    since = np.searchsorted(total, total[1:] - min_words, "right") - 1
    ahead = to <= stop
    back = (since >= begin) & (to[np.maximum(since, 0)] != i + 1)      # unless it is the shortest from its first sentence too
    tail = ~ahead & (stop - i >= RUN)
    at = np.concatenate([i[ahead], since[back], i[tail]])
    return at, np.concatenate([to[ahead], i[back] + 1, stop[tail]]) - at


def _packed(at, ids, null, digest, row, h, pos, n):
    """Entries by block; rows ascend within a block."""
    order = np.lexsort((pos, row, at))
    at, row, h, pos, n = at[order], row[order], h[order], pos[order], n[order]
    start, out = run_starts(at), {}
    for a, b in zip(start, np.append(start[1:], len(at))):
        first = run_starts(row[a:b])
        k = row[a:b][first]
        out[int(at[a])] = pack(id=ids[k], null=null[k], digest=digest[k], count=np.diff(np.append(first, b - a)).astype(np.uint32),
                               h=h[a:b], pos=pos[a:b].astype(np.uint32), n=n[a:b].astype(np.uint16))
    return out


def _run_pass(blocks: int, run: int | None, min_words: int):
    def go(batches):
        for rows, data, offs in text_slices(batches, "text"):
            col = rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64())
            null = col.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = col.fill_null(-(1 << 63)).to_numpy()
            digest = rows.column(rows.schema.get_field_index("digest")).to_numpy()
            h, row, pos, n = runs(data, offs, run, min_words)
            order = np.lexsort((pos, digest[row], ids[row], h))
            h, row, pos, n = h[order], row[order], pos[order], n[order]
            new = first_of(h)
            at = block_of(h, blocks)
            sent = _packed(at[new], ids, null, digest, row[new], h[new], pos[new], n[new])
            # later ones of the slice are repeats whatever the others hold, unless they are the same place of a repeated row
            lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
            twin = (ids[row] == ids[row[lead]]) & (digest[row] == digest[row[lead]]) & (pos == pos[lead])
            gone = ~twin
            # decided places meet nothing in a block, so they are dealt by document
            home = block_of(mix(ids.view(np.uint64) * np.uint64(3) + digest.view(np.uint64)), blocks)
            done = _packed(home[row[gone]], ids, null, digest, row[gone], h[gone], pos[gone], n[gone])
            keys = sorted({*sent, *done})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sent.get(k) for k in keys], pa.binary()),
                                              pa.array([done.get(k) for k in keys], pa.binary())], names=["block", "payload", "done"])
    return go


def _read(raws):
    got = [unpack(raw, [*_ROW, "<u8", "<u4", "<u2"]) for raw in raws if raw is not None]
    if not got:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint8), z, z.astype(np.uint64), z, z
    return tuple(np.concatenate([np.repeat(g[k], g[3]) for g in got]) for k in range(3)) + (
        np.concatenate([g[4] for g in got]), *(np.concatenate([g[k] for g in got]).astype(np.int64) for k in (5, 6)))


def _later(key, table):
    """Of a block: the places whose run came first elsewhere, by text; a place is first sentence << 16 | sentences."""
    ids, null, digest, h, pos, n = _read(table.column("payload").to_pylist())
    order = np.lexsort((pos, digest, ids, h))
    ids, null, digest, h, pos, n = (x[order] for x in (ids, null, digest, h, pos, n))
    new = first_of(h)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    gone = ~((ids == ids[lead]) & (digest == digest[lead]) & (pos == pos[lead]))
    more = _read(table.column("done").to_pylist())
    ids, null, digest, pos, n = (np.concatenate([x[gone], y]) for x, y in ((ids, more[0]), (null, more[1]), (digest, more[2]), (pos, more[4]), (n, more[5])))
    order = np.lexsort((pos, digest, ids))
    ids, null, digest, place = ids[order], null[order], digest[order], (pos << 16 | n)[order]
    new = first_of(ids)
    new[1:] |= digest[1:] != digest[:-1]
    start = np.flatnonzero(new)
    parts = [np.unique(place[a:b]).tolist() for a, b in zip(start, np.append(start[1:], len(ids)))]
    return pa.table({"id": pa.array(ids[start], pa.int64()), "digest": pa.array(digest[start], pa.int64()), "at": pa.array(parts, pa.list_(pa.int64()))})


def _cut(columns: list[str], text: str):
    """Texts without their repeated sentences."""
    def go(batches):
        for rows, data, offs in text_slices(batches, text):
            s, e, row, _ = sentences(data, offs)
            first = np.searchsorted(row, np.arange(len(offs)))
            raw, cut = data.tobytes(), offs.tolist()
            texts, total, removed, spans = [], [], [], []
            for k, parts in enumerate(rows.column(rows.schema.get_field_index("at")).to_pylist()):
                a, b = int(first[k]), int(first[k + 1])
                drop = np.zeros(b - a, bool)
                for p in {q for part in parts or [] for q in part}:
                    drop[p >> 16:(p >> 16) + (p & 0xFFFF)] = True
                total.append(b - a)
                removed.append(int(drop.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
                spans.append(len(edge) // 2)
                kept, at = [], cut[k]
                for x, y in zip(edge[::2], edge[1::2]):       # a sentence goes with the white space behind it
                    kept.append(raw[at:s[a + x]])
                    at = int(s[a + y]) if a + y < b else cut[k + 1]
                kept.append(raw[at:cut[k + 1]])
                texts.append(b"".join(kept).decode("utf-8"))
            src = [rows.column(rows.schema.get_field_index(c)) for c in columns]
            src = [pa.array([t if v else None for t, v in zip(texts, x.is_valid().to_pylist())], pa.string()) if c == text else x for c, x in zip(columns, src)]
            yield pa.RecordBatch.from_arrays(src + [pa.array(v, pa.int64()) for v in (total, removed, spans)],
                                             names=columns + ["n_sentences", "n_removed", "n_spans"])
    return go


def drop_repeated_sentences(docs: DataFrame, text: str = "text", run: int | None = RUN, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with repeated spans removed from their texts, and ``n_sentences, n_removed, n_spans``."""
    counts = ("n_sentences", "n_removed", "n_spans")
    rows, place = numbered(docs.select(*[quoted(c) for c in docs.columns if c not in counts]))
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col(place[text]), F.lit(""))), 1, 16), 16, -10).cast("long")
    doc_id = F.col(place["doc_id"]).cast("long")
    src = rows.select(doc_id.alias("doc_id"), F.col(place[text]).alias("text"), digest.alias("digest"))
    blocks = n_blocks(text_bytes(src), block_bytes)
    later = src.mapInArrow(_run_pass(blocks, run, min_words), "block long, payload binary, done binary") \
        .groupBy("block").applyInArrow(_later, "id long, digest long, at array<long>") \
        .groupBy("id", "digest").agg(F.collect_list("at").alias("at"))
    joined = rows.join(later, (F.coalesce(doc_id, F.lit(-(1 << 63))) == F.col("id")) & (digest == F.col("digest")), "left").select(*rows.columns, "at")
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return named_back(joined.mapInArrow(_cut(rows.columns, place[text]), schema), place | {c: c for c in counts})


def op5_sentence_spans(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_sentences(docs).select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_whole_spans(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_sentences(docs, run=None).select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT rid, doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT rid, doc_id, string_split(regexp_replace(
      regexp_replace(text, '([\x20\x09-\x0D]*\n[\x20\x09-\x0D]*)', '\1' || chr(1), 'g'), '([{ENDERS}][\x20\x09-\x0D]+)', '\1' || chr(1), 'g'), chr(1)) AS ps FROM d)),
u AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS pos, regexp_extract(piece, '^[\x20\x09-\x0D]*(.*?)[\x20\x09-\x0D]*$', 1, 's') AS t,
      len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS n FROM p WHERE regexp_matches(piece, '[^\x20\x09-\x0D]')),
r AS (SELECT rid, doc_id, pos, t, lead(t, 1) OVER o AS t2, lead(t, 2) OVER o AS t3, n + lead(n, 1) OVER o + lead(n, 2) OVER o AS w
      FROM u WINDOW o AS (PARTITION BY rid ORDER BY pos)),
k AS (SELECT rid, pos, row_number() OVER (PARTITION BY t, t2, t3 ORDER BY doc_id, pos) AS place FROM r WHERE w >= {MIN_WORDS} AND t3 IS NOT NULL),
g AS (SELECT DISTINCT rid, unnest([pos, pos + 1, pos + 2]) AS pos FROM k WHERE place > 1),
m AS (SELECT u.rid, u.i, u.pos, g.pos IS NOT NULL AS gone, coalesce(lag(g.pos) OVER (PARTITION BY u.rid ORDER BY u.pos), -1) AS before
      FROM u LEFT JOIN g ON g.rid = u.rid AND g.pos = u.pos),
t AS (SELECT p.rid, string_agg(CASE WHEN coalesce(m.gone, false) THEN '' ELSE p.piece END, '' ORDER BY p.i) AS kept,
      count(m.pos) AS n_sentences, count(*) FILTER (m.gone) AS n_removed, count(*) FILTER (m.gone AND m.before < 0) AS n_spans
      FROM p LEFT JOIN m ON m.rid = p.rid AND m.i = p.i GROUP BY p.rid)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (rid)"""

# sentences and removal as above; a run is at most MIN_WORDS sentences long, as each has a word
OP5_WHOLE_SQL = OP5_SQL[:OP5_SQL.index("r AS (")] + rf"""z AS (SELECT rid, doc_id, pos, list(t) OVER o AS ts, list(n) OVER o AS ns, count(*) OVER (PARTITION BY rid) AS last
      FROM u WINDOW o AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
w AS (SELECT rid, doc_id, pos, last, size, ts[1:size] AS run, list_sum(ns[1:size]) AS w, list_sum(ns[1:size]) - ns[size] AS w_front, list_sum(ns[1:size]) - ns[1] AS w_back
      FROM z, range(1, {MIN_WORDS + 1}) AS s(size) WHERE size <= len(ts)),
k AS (SELECT rid, pos, size, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS place FROM w
      WHERE (w >= {MIN_WORDS} AND (w_front < {MIN_WORDS} OR w_back < {MIN_WORDS})) OR (w < {MIN_WORDS} AND size >= {RUN} AND pos + size - 1 = last)),
g AS (SELECT DISTINCT rid, unnest(range(pos, pos + size)) AS pos FROM k WHERE place > 1),
""" + OP5_SQL[OP5_SQL.index("m AS ("):]

QUERIES = {"op5_sentence_spans": (op5_sentence_spans, OP5_SQL), "op5_whole_spans": (op5_whole_spans, OP5_WHOLE_SQL)}
