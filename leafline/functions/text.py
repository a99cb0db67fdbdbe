"""Text normalisers and recognisers as Column expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number or a code, as a key, and as a line of dashes.
NUMBER = r"^[-+~]?[0-9]+([.,:：/~\-][0-9]+)*(%|[A-Za-z]+)?$"
DATE = r"^[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}$"
PLACEHOLDERS = ("-", "—", "–", "－")
#: Words that name nothing, and the ways to spell short forms out.
GENERIC_TERMS = ("信息", "数据", "内容", "文档", "字段", "记录", "记录集合", "提取", "解析", "结果")
SHORT_FORMS = (
    ("id", "identifier"),
    ("no", "number"),
    ("no", "num"),
    ("num", "number"),
    ("num", "no"),
    ("qty", "quantity"),
    ("amt", "amount"),
    ("desc", "description"),
    ("uom", "unit of measure"),
    ("uom", "unit"),
)


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, which SQL has no function for."""

    def composed(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in values:
            yield part.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.pandas_udf(composed, "string")(text)


def spaces(text: Column) -> Column:
    """White space of any script, and split marks, as single spaces; trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("<|txt_split|>"), F.lit(" ")), r"(?U)\s+", " "))


def decoded(text: Column) -> Column:
    """Character references of every kind decoded, which SQL has no function for."""

    def plain(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in values:
            yield part.map(html.unescape, na_action="ignore")

    return F.pandas_udf(plain, "string")(text)


def cell_text(markup: Column) -> Column:
    """The text of a cell: breaks are new lines, images their alt text, tags gone, references decoded."""
    text = F.regexp_replace(markup, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?is)<img\b[^>]*?\balt=\"([^\"]*)\"[^>]*>", "$1")
    text = F.replace(decoded(F.regexp_replace(text, r"<[^>]+>", "")), F.lit("\u00a0"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), r"\s*\n\s*", "\n"))


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(text, r"<[^>]+>", " ")), r"(?U)\s+", " "))


def match_key(text: Column) -> Column:
    """Lower-case ASCII letters, digits and CJK; all else, accented letters too, is dropped."""
    return F.regexp_replace(F.lower(text), r"[^0-9a-zA-Z一-鿿]+", "")


def field_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s_\-:：]+", "")


def locator_key(text: Column) -> Column:
    """Compatibility composition in lower case without white space, separators, brackets, quotes and bars."""
    return locator_signs(nfkc(text))


def locator_signs(text: Column) -> Column:
    """``locator_key`` of a text that is composed already."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s_\-./\\|:：,，。;；()（）\[\]{}<>《》\"'`]+", "")


def evaluation_key(text: Column) -> Column:
    """A text as it is compared in an evaluation: composed, lower case, without white space, runs of separators one, CJK punctuation as ASCII."""
    key = F.regexp_replace(F.lower(F.trim(nfkc(F.coalesce(text, F.lit(""))))), r"(?U)\s+", "")
    key = F.regexp_replace(key, r"([,，、;；:/\\|])\1+", "$1")
    # a run of list separators is its first one, after which equal ones may touch again
    key = F.regexp_replace(F.regexp_replace(key, r"([,，、;；])[,，、;；]+", "$1"), r"([,，、;；:/\\|])\1+", "$1")
    return F.translate(key, "，、；：（）＜＞", ",,;:()<>")


def terms(text: Column) -> Column:
    """The whole text and its runs of two or more word signs or CJK, as distinct locator keys of two signs or more."""
    composed = nfkc(text)
    found = F.concat(F.array(composed), F.regexp_extract_all(composed, F.lit(r"([A-Za-z0-9_\-.]{2,}|[一-鿿]{2,})"), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(found, locator_signs), lambda x: F.length(x) >= 2))


def useful(term: Column) -> Column:
    """Whether a composed term names something: not generic, of two signs or more, of three if all are ASCII letters and digits."""
    key = locator_signs(term)
    return ~F.trim(term).isin(*GENERIC_TERMS) & ~key.isin(*GENERIC_TERMS) & (F.length(key) >= 2) & ~((F.length(key) < 3) & key.rlike("^[a-z0-9]+$"))


def useful_terms(found: Column, most: int = 48) -> Column:
    """Distinct useful terms, trimmed, the first ``most``."""
    return F.slice(F.array_distinct(F.transform(F.filter(found, useful), lambda x: F.trim(x))), 1, most)


def query_grams(text: Column, most: int = 24) -> Column:
    """Words of a query, with their pairs of signs if longer than three and triples if longer than five."""
    words = F.filter(F.split(F.lower(text), r"[\s,，.。;；:：/|_\-]+"), lambda x: x != "")

    def grams(word: Column) -> Column:
        n = F.length(word)
        two = F.when(n > 3, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        three = F.when(n > 5, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(word, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(word), two, three)

    return F.slice(F.array_distinct(F.flatten(F.transform(words, grams))), 1, most)


def structure_tokens(text: Column, most: int = 80) -> Column:
    """Tokens of up to 24 signs, each token of more than three followed by the pairs at its first 18 places; distinct, the first ``most``."""
    tokens = F.filter(F.split(text, r"(?U)\s+|/|,|，|、|;|；|\||：|:|\(|\)|（|）"), lambda x: x != "")

    def of(token: Column) -> Column:
        n = F.length(token)
        none = F.array().cast("array<string>")
        pairs = F.when(n > 3, F.transform(F.sequence(F.lit(1), F.least(n - 1, F.lit(18))), lambda i: F.substring(token, i, F.lit(2)))).otherwise(none)
        return F.concat(F.when(n <= 24, F.array(token)).otherwise(none), pairs)

    return F.slice(F.array_distinct(F.flatten(F.transform(tokens, of))), 1, most)


def variants(term: Column) -> Column:
    """Ways to write a term, in order and distinct.

    As composed, with capitals apart, with separators as spaces, without any, in
    title case, with each short form spelt out in each way, apart and joined,
    and in capitals where it has no others or no more than five signs. Tags are
    blanks and invisible signs are gone; a generic term has none.
    """
    text = F.trim(nfkc(term))
    plain = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"[\u200b\u200c\u200d\ufeff]+", "")
    return F.when(F.coalesce(text, F.lit("")).isin("", *GENERIC_TERMS), F.array().cast("array<string>")).otherwise(bound(plain, _spelt))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _spelt(text: Column) -> Column:
    camel = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    apart = F.regexp_replace(camel, r"[_\-./\\|]+", " ")
    parts = F.filter(F.split(apart, r"(?U)\s+"), lambda x: x != "")
    title = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), " ")
    forms = F.array(*[F.struct(F.lit(a).alias("short"), F.lit(b).alias("long")) for a, b in SHORT_FORMS])

    def written(part: Column, i: Column) -> Column:
        fitting = F.filter(forms, lambda f: f["short"] == F.lower(part))
        return F.flatten(F.transform(fitting, lambda f: _both(F.array_join(F.transform(parts, lambda x, j: F.when(j == i, f["long"]).otherwise(x)), " "))))

    capitals = F.when(((F.upper(text) == text) & (F.lower(text) != text)) | (F.length(text) <= 5), F.array(F.upper(text))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.array(text, camel, apart, F.regexp_replace(camel, r"(?U)[\s_\-./\\|]+", ""), title), F.flatten(F.transform(parts, written)), capitals)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(*GENERIC_TERMS)))


def _both(text: Column) -> Column:
    return F.array(text, F.regexp_replace(text, r"(?U)\s+", ""))


def excerpt(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def safe_name(text: Column) -> Column:
    """A name that can be a file or an object: other signs than letters, digits and CJK become one underscore."""
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^0-9A-Za-z一-鿿_\-]+", "_"), r"^_+|_+$", "")
    return F.when(cleaned == "", F.lit("item")).otherwise(cleaned)


def first_decimal(text: Column) -> Column:
    return F.regexp_extract(text, r"-?[0-9]+(\.[0-9]+)?", 0)


def date_text(text: Column) -> Column:
    """The first date of a text as ``YYYY.MM.DD``, empty if none."""
    part = [F.regexp_extract(text, r"([0-9]{4})[./-]([0-9]{1,2})[./-]([0-9]{1,2})", k) for k in (1, 2, 3)]
    return F.when(part[0] == "", F.lit("")).otherwise(F.concat_ws(".", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")))


def ratio_text(actual: Column, whole: Column) -> Column:
    """A percentage to one decimal, halves up; empty where the whole is zero or missing."""
    value = F.round(actual.cast("decimal(18,4)") * 100 / whole.cast("decimal(18,4)"), 1)
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit("")).otherwise(F.concat(value.cast("decimal(18,1)").cast("string"), F.lit("%")))


def first_json(text: Column) -> Column:
    """The first object of a text that parses, from its first brace to the last that closes it; null if none."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)


def numeric_or_code(cell: Column) -> Column:
    """Whether a cell is a number, a date, or up to 32 signs with ASCII digits and letters and without CJK; one pattern, as each is run anew for each cell."""
    return F.trim(cell).rlike(rf"{NUMBER}|{DATE}|^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[^一-鿿]{{1,32}}\z")


def like_key(cell: Column, most: int = 40) -> Column:
    """Whether a cell names something: short, not a number or code, fewer digits than other signs."""
    text = F.trim(cell)
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return (text != "") & (F.length(text) <= most) & ~numeric_or_code(text) & (digits * 2 <= F.length(text))


def id_matches(candidate: Column, wanted: Column) -> Column:
    """The id itself, or one that ends with it after a separator."""
    return (candidate == wanted) | F.exists(F.array(*map(F.lit, "-_:/#")), lambda sign: F.endswith(candidate, F.concat(sign, wanted)))


def layout_mark(kind: Column, title: Column) -> Column:
    """Whether a block is a running header, footer, watermark or page number."""
    return F.lower(F.concat_ws(" ", kind, title)).rlike(r"header|footer|watermark|page[_ -]?number|页眉|页脚|水印|页码")


