r"""Document fingerprints by I-Match over randomised lexicon subsets.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII,
lower-cased.  The lexicon holds the terms whose inverse document frequency lies in a band: found
in ``MIN_DOCS`` documents or more, and in at most ``MAX_SHARE`` of all.  The first 60 bits of a
term's md5 place it in the lexicon subsets: at scale j the lexicon falls into 2**j random subsets
of equal odds, and the first 32 of them are hashed.  A text uses the finest scale whose subsets hold
more than one of its distinct terms on average, and the next finer one, so texts of any length that share most of
their terms share subsets.  A subset's hash is that of its sorted distinct terms.

A fingerprint reads ``<mode><scale>:<32 x 4 hex digits>:<32 x 4 hex digits>``, ``....`` standing for a
subset without a term.  Mode ``b`` has lexicon terms; ``a`` has none in its subsets and hashes all terms
there, so rare short texts are told apart; ``e`` has no terms at all.  The likeness of two fingerprints is the share of
equal hashes among the subsets that hold a term in either, at the finer of their scales; equal ones have 1, those
of other modes or more than one scale apart 0.

Everything is DataFrame functions.  Only terms of the hashed subsets (32 to 64 a text, whatever its
length) meet the lexicon in a join; terms above the band, whose number is bounded by the mean
of distinct terms a text over ``MAX_SHARE``, are taken out first, so no join key is hot.

Defined results: null counts as the empty text; rows of equal id follow each other by the md5 of the text, null ids
come first; the last row's next is the first, a single row's next is itself; repeated rows are
rows of their own and equal texts have equal fingerprints; an empty table gives an empty result.  Other columns of the table, whatever
their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .exchange import n_blocks, text_bytes

MIN_DOCS = 2
MAX_SHARE = 0.05
SUBSETS = 32
SCALE = 5                        # 2 ** SCALE = SUBSETS
BITS = 60
HEX = 4
EMPTY = "." * HEX
RUN_BYTES = 64 << 20             # texts of one ordered run
STOP_ROWS = 1 << 20              # 8 MB of codes

# every ASCII character but letters and digits
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), BETWEEN)), lambda w: w != "")


def _digest(term: Column) -> Column:
    return F.substring(F.md5(term), 1, BITS // 4)


def _code(digest: Column) -> Column:
    return F.conv(digest, 16, 10).cast("long")


def scale_of(words: Column) -> Column:
    """Largest scale whose subsets hold more than one of the terms on average, ``SCALE`` at least."""
    return F.greatest(F.lit(SCALE), F.length(F.bin((F.greatest(F.size(words), F.lit(1)) - 1).cast("long"))) - 1)


def _width(scale: Column) -> Column:
    """Codes of one subset."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(BITS) - scale)


def in_subsets(words: Column, scale: Column) -> Column:
    """Codes of the terms that fall into the hashed subsets of a scale (digests compare like codes)."""
    below = F.when(scale == SCALE, "g").otherwise(F.lpad(F.hex(_width(scale) * SUBSETS), BITS // 4, "0"))
    return F.transform(F.filter(F.transform(words, _digest), lambda d: d < below), _code)


def _let(fn, **values: Column) -> Column:
    """``fn`` of a struct of values, each of them computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), fn)[0]


def _tokens(codes: Column, scale: Column) -> Column:
    """The hashes of one scale, of sorted codes: a subset's terms stand side by side."""
    here = F.filter(codes, lambda c: c < _width(scale) * SUBSETS)
    subset = F.transform(here, lambda c: F.floor((c - c % _width(scale)) / _width(scale)).cast("int"))

    def one(v, s):
        at = F.array_position(v.at, s).cast("int")
        terms = F.slice(v.text, at, F.size(v.at) + 2 - F.array_position(F.reverse(v.at), s).cast("int") - at)
        return F.when(at == 0, EMPTY).otherwise(F.substring(F.md5(F.array_join(terms, ",")), 1, HEX))
    return _let(lambda v: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: one(v, s)), ""),
                at=subset, text=F.transform(here, lambda c: c.cast("string")))


def fingerprint_of(mode: Column, codes: Column, scale: Column) -> Column:
    """Fingerprint from the sorted codes that count."""
    return F.concat(mode, F.lpad(scale.cast("string"), 2, "0"), F.lit(":"), _tokens(codes, scale), F.lit(":"), _tokens(codes, scale + 1))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes, 0 to 1."""
    sa, sb = F.substring(a, 2, 2).cast("int"), F.substring(b, 2, 2).cast("int")
    wide = SUBSETS * HEX

    def at_finer(f, mine):
        return F.when(mine == F.greatest(sa, sb), F.substring(f, 5, wide)).otherwise(F.substring(f, 6 + wide, wide))

    def places(v, test):
        return F.size(F.filter(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: test(F.substr(v.x, k * HEX + 1, F.lit(HEX)), F.substr(v.y, k * HEX + 1, F.lit(HEX)))))
    filled = _let(lambda v: places(v, lambda x, y: (x != EMPTY) | (y != EMPTY)), x=at_finer(a, sa), y=at_finer(b, sb))
    same = _let(lambda v: places(v, lambda x, y: (x == y) & (x != EMPTY)), x=at_finer(a, sa), y=at_finer(b, sb))
    apart = (F.substring(a, 1, 1) != F.substring(b, 1, 1)) | (F.abs(sa - sb) > 1)
    return F.when(a == b, 1.0).when(apart, 0.0).otherwise(F.coalesce(same / F.nullif(filled, F.lit(0)), F.lit(0.0)))


def lexicon_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``code, df`` of every term."""
    words = docs.select(F.explode(terms(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(_code(_digest(F.col("term"))).alias("code"), "df")


def with_next(docs: DataFrame, text: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """``place, n_rows, doc_id, text, next_text``: rows in order of id with the text that follows.

    Rows are dealt into runs of bounded bytes by their sorted keys (one boundary key a run reaches the
    driver); within a run a window sees the next row, and a run's last row gets the first of the next run by a join."""
    # one sortable key: null ids first, then the id shifted to unsigned, then the text
    order = F.concat(F.when(F.col("doc_id").isNull(), "0").otherwise(F.concat(F.lit("1"), F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))),
                     F.md5("text"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("key", order)
    runs = n_blocks(text_bytes(src), run_bytes)
    dealt = src.select("key").repartitionByRange(runs, "key").select("key", F.spark_partition_id().alias("part"))
    first = sorted((r.key, r.n) for r in dealt.groupBy("part").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).collect())
    if not first:
        return src.select(F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("n_rows"), "doc_id", "text", F.col("text").alias("next_text"))
    bounds = F.split(F.lit(",".join(k for k, _ in first)), ",")
    before, total = [], 0
    for _, n in first:
        before.append(str(total))
        total += n
    steps = [1 << b for b in reversed(range(len(first).bit_length()))]
    # binary search: the number of boundaries at or below the key
    run = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= F.col("key"), at + s).otherwise(at))
    src = src.withColumn("run", run)
    heads = src.filter(F.get(bounds, F.col("run") - 1) == F.col("key")).dropDuplicates(["run"]) \
        .select(F.when(F.col("run") == 1, F.lit(len(first))).otherwise(F.col("run") - 1).alias("run"), F.col("text").alias("head"))
    inside = Window.partitionBy("run").orderBy("key")
    placed = src.select("run", "doc_id", "text", F.lead("text").over(inside).alias("after"), F.row_number().over(inside).alias("rank"))
    offset = F.get(F.split(F.lit(",".join(before)), ","), F.col("run") - 1).cast("long")
    return placed.join(heads, "run", "left").select((offset + F.col("rank") - 1).alias("place"), F.lit(total).cast("long").alias("n_rows"), "doc_id", "text",
                                                    F.coalesce("after", "head").alias("next_text"))


def with_fingerprints(rows: DataFrame, key: str, sides: dict[str, tuple[str, str]], counts: DataFrame, n_docs: int,
                      min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Fingerprints of several texts of each row.  ``sides`` maps a fingerprint's name to the columns of its
    kept codes and scale; ``key`` is unique."""
    counts = cut_lineage(counts.filter(F.col("df") >= min_docs))
    above = counts.filter(F.col("df") > max_share * n_docs).select("code")
    def of_side(k, kept):
        return F.transform(kept, lambda c: F.struct(F.lit(k).alias("side"), c.alias("code")))
    pairs = rows.select(key, F.explode(F.concat(*[of_side(k, kept) for k, (kept, _) in enumerate(sides.values())])).alias("p")) \
        .select(key, "p.side", "p.code")
    pairs = pairs.join(F.broadcast(above) if above.count() <= STOP_ROWS else above, "code", "left_anti")
    band = pairs.join(counts.filter(F.col("df") <= max_share * n_docs).select("code"), "code") \
        .groupBy(key).agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("code")))).alias(f"__band{k}") for k in range(len(sides))])
    none = F.array().cast("array<long>")
    out = rows.join(band, key, "left").select(*rows.columns, *[F.coalesce(f"__band{k}", none).alias(f"__band{k}") for k in range(len(sides))])
    out = out.withColumns({f"__mode{k}": F.when(F.size(f"__band{k}") > 0, "b").when(F.size(kept) > 0, "a").otherwise("e") for k, (kept, _) in enumerate(sides.values())}
                          | {f"__band{k}": F.when(F.size(f"__band{k}") > 0, F.col(f"__band{k}")).otherwise(F.array_sort(kept)) for k, (kept, _) in enumerate(sides.values())})
    return out.select(*rows.columns, *[fingerprint_of(F.col(f"__mode{k}"), F.col(f"__band{k}"), F.col(scale)).alias(name) for k, (name, (_, scale)) in enumerate(sides.items())])


def edited_fingerprints(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edit: the last half of its code points replaced by
    the first as many of the next text."""
    rows = with_next(docs, text, run_bytes)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("place", "n_rows", "doc_id", "text", n.cast("long").alias("n_chars"),
                       F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)).alias("edited"))
    rows = rows.select("place", "n_rows", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("new"))
    rows = rows.withColumns({"own_scale": scale_of(F.col("own")), "new_scale": scale_of(F.col("new"))})
    # only what is hashed goes on
    rows = cut_lineage(rows.select("place", "n_rows", "doc_id", "n_chars", "edited_sha256", "own_scale", "new_scale",
                                   in_subsets(F.col("own"), F.col("own_scale")).alias("own"), in_subsets(F.col("new"), F.col("new_scale")).alias("new")))
    n_docs = rows.count()
    out = with_fingerprints(rows, "place", {"fingerprint": ("own", "own_scale"), "edited_fingerprint": ("new", "new_scale")},
                            lexicon_counts(docs, text), n_docs, min_docs, max_share)
    out = out.select("place", "n_rows", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    after = out.select(F.pmod(F.col("place") - 1, F.col("n_rows")).alias("place"), F.col("fingerprint").alias("next_fingerprint"))
    out = out.join(after, "place")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op12_imatch_fingerprints(spark, sf_dir) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# the same rule on lists
OP12_SQL = r"""WITH
d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS g, count(*) OVER () AS n_rows FROM documents),
e AS (SELECT a.g, a.n_rows, a.doc_id, a.t, length(a.t) AS n, a.t[:length(a.t) - length(a.t) // 2] || b.t[:length(a.t) // 2] AS e FROM d a JOIN d b ON b.g = (a.g + 1) % a.n_rows),
x AS (SELECT g, 1 AS side, t AS s FROM e UNION ALL SELECT g, 2, e FROM e),
c AS (SELECT g, side, list_transform(list_filter(list_distinct(regexp_split_to_array(lower(s), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 15) AS BIGINT)) AS codes FROM x),
j AS (SELECT g, side, codes, greatest(5, length(bin(greatest(len(codes), 1) - 1)) - 1) AS j FROM c),
f AS (SELECT u.code, count(*) AS df FROM (SELECT unnest(codes) AS code FROM c WHERE side = 1) u GROUP BY 1),
k AS (SELECT g, side, j, list_filter(codes, lambda q: q < (1::BIGINT << (60 - j)) * 32) AS kept FROM j),
b AS (SELECT k.g, k.side, list_sort(list(u.code)) AS band FROM (SELECT g, side, unnest(kept) AS code FROM k) u JOIN k USING (g, side) JOIN f ON f.code = u.code
      WHERE f.df >= 2 AND f.df <= 0.05::DOUBLE * (SELECT count(*) FROM d) GROUP BY 1, 2),
l AS (SELECT k.g, k.side, k.j, CASE WHEN b.band IS NOT NULL THEN 'b' WHEN len(k.kept) > 0 THEN 'a' ELSE 'e' END AS mode, coalesce(b.band, list_sort(k.kept)) AS codes FROM k LEFT JOIN b USING (g, side)),
s AS (SELECT g, side, j, mode, [list_filter(codes, lambda q: q >= z * (1::BIGINT << (60 - j)) AND q < (z + 1) * (1::BIGINT << (60 - j))) FOR z IN range(32)] AS p0,
      [list_filter(codes, lambda q: q >= z * (1::BIGINT << (59 - j)) AND q < (z + 1) * (1::BIGINT << (59 - j))) FOR z IN range(32)] AS p1 FROM l),
t AS (SELECT g, side, j, mode, [CASE WHEN len(p) = 0 THEN '....' ELSE substr(md5(array_to_string(p, ',')), 1, 4) END FOR p IN p0] AS t0,
      [CASE WHEN len(p) = 0 THEN '....' ELSE substr(md5(array_to_string(p, ',')), 1, 4) END FOR p IN p1] AS t1 FROM s),
p AS (SELECT *, mode || lpad(CAST(j AS VARCHAR), 2, '0') || ':' || array_to_string(t0, '') || ':' || array_to_string(t1, '') AS fp FROM t),
m AS (SELECT e.g, e.doc_id, e.n, sha256(e.e) AS sha, a.fp AS fa, b.fp AS fb, c.fp AS fc, a.mode AS ma, b.mode AS mb, c.mode AS mc, a.j AS ja, b.j AS jb, c.j AS jc,
      CASE WHEN a.j >= b.j THEN a.t0 ELSE a.t1 END AS ab, CASE WHEN b.j >= a.j THEN b.t0 ELSE b.t1 END AS ba,
      CASE WHEN a.j >= c.j THEN a.t0 ELSE a.t1 END AS ac, CASE WHEN c.j >= a.j THEN c.t0 ELSE c.t1 END AS ca
      FROM e JOIN p a ON a.g = e.g AND a.side = 1 JOIN p b ON b.g = e.g AND b.side = 2 JOIN p c ON c.g = (e.g + 1) % e.n_rows AND c.side = 1),
v AS (SELECT *, len([z FOR z IN range(1, 33) IF ab[z] <> '....' OR ba[z] <> '....']) AS u1, len([z FOR z IN range(1, 33) IF ab[z] = ba[z] AND ab[z] <> '....']) AS s1,
      len([z FOR z IN range(1, 33) IF ac[z] <> '....' OR ca[z] <> '....']) AS u2, len([z FOR z IN range(1, 33) IF ac[z] = ca[z] AND ac[z] <> '....']) AS s2 FROM m)
SELECT doc_id, n AS n_chars, sha AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
 CAST(CASE WHEN fa = fb THEN 1.0 WHEN ma <> mb OR abs(ja - jb) > 1 OR u1 = 0 THEN 0.0 ELSE s1::DOUBLE / u1 END AS DOUBLE) AS near_edited,
 CAST(CASE WHEN fa = fc THEN 1.0 WHEN ma <> mc OR abs(ja - jc) > 1 OR u2 = 0 THEN 0.0 ELSE s2::DOUBLE / u2 END AS DOUBLE) AS near_next FROM v"""

QUERIES = {"op12_imatch_fingerprints": (op12_imatch_fingerprints, OP12_SQL)}
