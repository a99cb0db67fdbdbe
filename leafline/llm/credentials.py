"""Secrets in texts, with multipart credential linking.

Three kinds of span stand alone: assignments, access identifiers and long hex
runs. Weaker parts (an account name, a bare key, an endpoint) say little by
themselves; an interval join inside each document's scope reports them only
where a complementary part lies near. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm.runtime import Tables, fresh

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_HINT = r"(?i)(?:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]"

#: Weak parts by kind: role and pattern.
WEAK = {
    "account": ("identifier", r"""(?i)\b(?:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""),
    "barekey": ("secret", r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"),
    "endpoint": ("endpoint", r"""\b(?:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{3,}"""),
}
KINDS = ["assign", "access", "hex", *WEAK]
ROLE_OF = {"assign": "secret", "access": "identifier", "hex": "secret"} | {kind: role for kind, (role, _) in WEAK.items()}
#: A part of this role counts where one of those roles lies within the scope.
NEEDS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


#: Parts of a text that are folded together.
RUN = 64


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _placed(text: Column, pattern: str, kind: str, value_group: int | None = None, least: int = 0) -> Column:
    """Spans of every match of ``pattern``: what lies between matches gives their places."""
    expression = F.lit(pattern)
    found = F.regexp_extract_all(text, expression, F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, expression, F.lit(value_group)) if value_group else found
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("match"), value.alias("value"))

    def add(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        good = part["match"].isNotNull() & (F.length(part["value"]) >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    def fold(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans")), add, lambda x: x["spans"])

    def begins(runs: Column) -> Column:
        """Where each run begins, and at last where the text ends."""
        width = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
        return F.aggregate(runs, F.array(F.lit(0).cast("long")), lambda done, run: F.concat(done, F.array(F.element_at(done, -1) + width(run))))

    # an array that grows in a fold is copied each time, so spans are folded a run of parts at a time
    runs = _bound(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda i: F.slice(p, i * RUN + 1, RUN)))
    spans = _bound(runs, lambda r: F.flatten(F.zip_with(r, F.slice(begins(r), 1, F.size(r)), fold)))
    return F.when(text.rlike(pattern if value_group is None else ASSIGN_HINT), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three kinds that stand alone, by start and kind; of null, none."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(_placed(text, ASSIGN, "assign", 2, 8), _placed(text, ACCESS, "access"), _placed(text, HEX, "hex"))
    return F.array_sort(found)


def weak_spans(text: Column) -> Column:
    """Spans of the weak parts, which count only beside others; of null, none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_placed(text, pattern, kind) for kind, (_, pattern) in WEAK.items()])


def linked_spans(found: DataFrame, scope: int = 400) -> DataFrame:
    """Weak parts that count, as ``key`` and ``extra`` spans, of rows ``key, base, weak``, one a key.

    The join is by document and cell of ``scope`` code points. A part is in all
    cells it covers, and asks in all that its surroundings cover, so what lies
    near either end is met, however long it is. Of a cell, each role hands over
    only its first and last place, so the rows joined grow with the parts and
    the length of the text, however dense they are.
    """
    parts = found.select("key", F.explode(F.concat("base", "weak")).alias("s"))
    role = F.create_map(*[F.lit(x) for pair in ROLE_OF.items() for x in pair])[F.col("s.kind")]
    parts = parts.select("key", "s", role.alias("role"))
    covered = parts.withColumn("cell", F.explode(F.expr(f"sequence(s.start div {scope}, s.end div {scope})")))
    cells = covered.groupBy("key", "cell", "role").agg(F.min("s.start").alias("first"), F.max("s.end").alias("last"))
    near = F.explode(F.expr(f"sequence(greatest(s.start - {scope}, 0) div {scope}, (s.end + {scope}) div {scope})"))
    needs = F.explode(F.when(F.col("role") == "secret", F.array(*map(F.lit, NEEDS["secret"]))).otherwise(F.array(F.lit("secret")))).alias("need")
    weak_parts = parts.where(F.col("s.rank") >= 3).select("key", "s", needs)
    asked = weak_parts.select("key", "s", F.col("need").alias("role"), near.alias("cell"))
    met = asked.join(cells, ["key", "role", "cell"])
    met = met.where((F.col("first") <= F.col("s.end") + scope) & (F.col("last") >= F.col("s.start") - scope))
    return met.groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("extra"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text_col: str, base: str, spans: str, scope: int = 400, keep_text: bool = True) -> DataFrame:
    """``docs`` with two more columns, ``base`` spans and all ``spans``, arrays of struct(start, rank, end, kind).

    Texts are read and searched once; what is found is written to the shared
    folder, with the other columns (``text_col`` only if ``keep_text``), and only
    rows with weak parts take part in the join.
    """
    text = F.col(text_col)
    weak, key, extra = (fresh([*docs.columns, base, spans], x) for x in ("weak", "key", "extra"))
    found = docs.withColumn(base, base_spans(text)).withColumn(weak, weak_spans(text)).withColumn(key, F.monotonically_increasing_id())
    found = Tables(docs.sparkSession).put(found if keep_text else found.drop(text_col))
    some = found.where(F.size(weak) > 0)
    linked = linked_spans(some.select(F.col(key).alias("key"), F.col(base).alias("base"), F.col(weak).alias("weak")), scope)
    linked = linked.select(F.col("key").alias(key), F.col("extra").alias(extra))
    more = some.join(linked, key, "left").withColumn(spans, F.array_sort(F.concat(base, F.coalesce(extra, F.array().cast(SPAN))))).drop(extra)
    return found.where(F.size(weak) == 0).withColumn(spans, F.col(base)).unionByName(more).drop(weak, key)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """Secrets of every text, whole.

    Returns per row ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.
    Offsets count code points and ends are exclusive. Null and empty texts have
    no spans. Repeated rows each get their result. Columns beside the two named
    are ignored; an empty table gives an empty result.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_spans(given, "text", "base", "spans", scope, keep_text=False)

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:3])],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["rank"] >= 3)).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scope: int = 400) -> DataFrame:
    """``docs`` with every secret span of its text replaced by ``mark``; endpoints stay.

    Overlapping spans are replaced together. Null and empty texts stay as they
    are, repeated rows each get their result, an empty table gives an empty
    result, and all other columns, whatever their names, are as they were.
    """
    base, spans = (fresh(docs.columns, x) for x in ("base", "spans"))
    found = with_spans(docs, text_col, base, spans, scope)
    marked = F.filter(spans, lambda s: s["kind"] != "endpoint")
    text = F.col(text_col)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def add(done: Column, s: Column) -> Column:
        ahead = s["start"] >= done["at"]
        piece = F.array(F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0))), F.lit(mark))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(ahead, F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"))

    whole = F.aggregate(marked, begin, add, lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(marked) > 0, whole).otherwise(text)).select(*docs.columns)
