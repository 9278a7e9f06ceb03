"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, its text alone under the loss mask.  A conversation that does not end
with an assistant turn gets one more example with the whole conversation and an
empty mask, so every turn can be read back from the output.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings
inside texts (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<SYS>``,
``</SYS>``) get a backslash behind their first character; where backslashes
already stand there one more is added, so taking one away restores any text.

The expansion is quadratic in a conversation's turns by nature.  A long
conversation is dealt to tasks in blocks of ``block`` targets, each with the
turns before its end; a task holds one prefix at a time.

Defined results: turns are ordered by ``turn`` (null first), ties by role and
text; null texts and roles are empty; a null ``conv_id`` is one conversation;
repeated rows are repeated turns; an empty table gives no example.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK = 64
EMIT_CHARS = 4 << 20

_ESCAPE = re.compile(r"<(?=\\*(?:\||/?s>|/?SYS>))|\[(?=\\*/?INST\])")
_UNESCAPE = re.compile(r"<\\(?=\\*(?:\||/?s>|/?SYS>))|\[\\(?=\\*/?INST\])")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted example."""
    return [(_unescape_role(r), unescape(t)) for r, t in _TURN.findall(text)]


EXAMPLES = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("target", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("text", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])


def _examples(batches):
    """Rows sorted by conversation, block and turn number to examples; one prefix is held at a time."""
    key, prefix, size, out, held = None, [], 0, [], 0
    for b in batches:
        for conv, block, i, n, lo, role, text in zip(*[b.column(k).to_pylist() for k in range(7)]):
            if key != (conv, block):
                key, prefix, size = (conv, block), [], 0
            head = f"{OPEN}{_escape_role(role)}\n"
            body = escape(text)
            prefix += [head, body, CLOSE]
            before, size = size, size + len(head) + len(body) + len(CLOSE)
            reply = role == "assistant"
            if i >= lo and (reply or i == n - 1):
                start = before + len(head) if reply else size
                out.append((conv, i, n, "".join(prefix), start, start + len(body) if reply else size))
                held += size
                if held > EMIT_CHARS:
                    yield pa.RecordBatch.from_pylist([dict(zip(EXAMPLES.names, r)) for r in out], schema=_ARROW)
                    out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(EXAMPLES.names, r)) for r in out], schema=_ARROW)


_ARROW = pa.schema([(f.name, pa.string() if f.name == "text" else pa.int64()) for f in EXAMPLES])


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Examples ``conv_id, target, n_turns, text, loss_start, loss_end`` (code points of ``text``).

    ``target`` is the number of the example's last turn in its conversation of ``n_turns``.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    whole = Window.partitionBy("conv_id")
    t = t.withColumn("i", (F.row_number().over(whole.orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1).cast("long")) \
        .withColumn("n", F.count(F.lit(1)).over(whole))
    blocks = F.sequence(F.expr(f"i div {block}"), F.expr(f"(n - 1) div {block}"))
    t = t.withColumn("block", F.explode(blocks)).select("conv_id", "block", "i", "n", (F.col("block") * block).alias("lo"), "role", "text")
    # a turn stands in its own block's examples and as context in later blocks; examples belong to lo <= i < lo + block
    return t.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "i").mapInArrow(_examples, EXAMPLES)


READ = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("target", T.LongType()), T.StructField("final", T.BooleanType()),
    T.StructField("formatted", T.LongType()), T.StructField("loss_text", T.StringType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("turns", T.LongType())])


def _read_back(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("target", pa.int64()), ("final", pa.bool_()), ("formatted", pa.int64()),
                        ("loss_text", pa.string()), ("turns_sha256", pa.string()), ("turns", pa.int64())])
    for b in batches:
        rows = []
        for conv, target, n, text, lo, hi in zip(*[b.column(k).to_pylist() for k in range(6)]):
            row = {"conv_id": conv, "target": target, "final": target == n - 1, "formatted": len(text), "loss_text": unescape(text[lo:hi])}
            if row["final"]:
                got, digest = read_turns(text), hashlib.sha256()
                for role, said in got:
                    digest.update(f"{role}\n{said}\n".encode())
                row |= {"turns_sha256": digest.hexdigest(), "turns": len(got)}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def op1_chat_formatting(spark, sf_dir) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = format_chats(turns).mapInArrow(_read_back, READ)
    per = back.groupBy("conv_id").agg(
        F.max("turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_sort(F.collect_list(F.struct("target", "loss_text"))).alias("replies"), F.sum("formatted").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"))
    loss = F.concat_ws("", F.transform("replies", lambda r: r["loss_text"]))
    return per.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      "formatted_chars", "n_examples")


# template lengths: marker, role, line feed, text with its escapes, end marker
_ESCAPED = r"regexp_replace(regexp_replace(text, '<(\\*(?:\||/?s>|/?SYS>))', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')"
OP1_SQL = rf"""WITH c AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
      sum({len(OPEN) + 1 + len(CLOSE)} + length(role) + length({_ESCAPED})) OVER w AS upto
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
 coalesce(sum(upto) FILTER (role = 'assistant' OR i = n), 0)::BIGINT AS formatted_chars,
 count(*) FILTER (role = 'assistant' OR i = n) AS n_examples FROM t GROUP BY conv_id"""

QUERIES = {"op1_chat_formatting": (op1_chat_formatting, OP1_SQL)}
