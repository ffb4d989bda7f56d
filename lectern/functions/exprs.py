"""Column expressions shared by the operators; all of them are built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that trimming removes.
WHITE = r"[\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# Characters of a call number that are encoded in its link, and the link below the catalogue.
CALL_NUMBER_CODES = {"/": "%2F", "#": "%23", "*": "%2A", " ": "%20", "+": "%2B", "=": "%3D", "?": "%3F", "&": "%26"}
CATALOGUE = "https://catalogue.example"
CALL_NUMBER_LINK = "/Search/Results?searchtype=vague&lookfor={call_number}&type=CallNumber"
# Chinese digits and month numbers.
DIGITS = "零一二三四五六七八九"
MONTHS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二"]

Col = Column | str


def _c(col: Col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def first_number(*cols: Col) -> Column:
    """The first that is neither null, NaN nor zero; else 0."""
    return F.coalesce(*[F.nullif(F.nanvl(_c(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols], F.lit(0.0))


def first_text(*cols: Col) -> Column:
    """The first that is neither null nor empty; else null."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def trimmed(col: Col) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(_c(col), f"^{WHITE}+|{WHITE}+$", "")


def is_blank(col: Col) -> Column:
    return F.coalesce(trimmed(col) == "", F.lit(True))


def number_text(col: Col) -> Column:
    """A number as text, whole ones without decimals."""
    x = _c(col).cast("double")
    return F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(x.cast("string"))


def call_number_link(col: Col, catalogue: str = CATALOGUE) -> Column:
    """The link of a call number in a catalogue; null for a blank one."""
    coded = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), CALL_NUMBER_CODES.items(), trimmed(col))
    head, tail = CALL_NUMBER_LINK.split("{call_number}")
    return F.when(~is_blank(col), F.concat(F.lit(catalogue + head), coded, F.lit(tail)))


def object_key(*parts: Col, base: str = "") -> Column:
    """Parts joined by one slash, base first; empty parts are left out."""
    clean = [F.regexp_replace(F.replace(_c(p), F.lit("\\"), F.lit("/")), "^/+|/+$", "") for p in parts]
    return F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in ([F.lit(base.strip("/"))] if base.strip("/") else []) + clean])


def public_url(path: Col) -> Column:
    """The site path of a local file; empty stays empty."""
    path = F.coalesce(_c(path), F.lit(""))
    return F.when(path == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace(path, "^/+", "")))


def image_url(primary: Col, fallback: Col | None = None, cdn: str = "") -> Column:
    """The first URL given; relative ones on the CDN or the site root."""
    url = F.coalesce(first_text(primary, *([] if fallback is None else [fallback])), F.lit(""))
    whole = url.rlike("(?i)^https?://") | url.startswith("/") | (url == "")
    return F.when(whole, url).otherwise(F.concat(F.lit(f"{cdn.rstrip('/')}/"), url))


def card_path(collection_id: Col, barcode: Col, kind: str = "card") -> Column:
    """The image route of a book: card, cover or cover-thumbnail."""
    return F.concat(F.lit("/api/images/"), _c(collection_id), F.lit("/"), _c(barcode), F.lit(f"/{kind}"))


def collection_kind(collection_id: Col) -> Column:
    c = _c(collection_id)
    return F.when(c.rlike(r"^\d{4}-subject-.+$"), "subject").when(c.rlike(r"^\d{4}-sleeping-.+$"), "sleeping_beauty").when(c.rlike(r"^\d{4}-\d{2}$"), "month")


def collection_year(collection_id: Col) -> Column:
    return F.regexp_extract(_c(collection_id), r"^(\d{4})-", 1)


def collection_name(collection_id: Col) -> Column:
    c = _c(collection_id)
    return F.when(collection_kind(c) == "month", c).otherwise(F.regexp_extract(c, r"^\d{4}-(?:subject|sleeping)-(.+)$", 1))


def collection_path(collection_id: Col) -> Column:
    """{year}/{id}, {year}/subject/{name} or {year}/new/{name}; other ids are their own path."""
    c = _c(collection_id)
    kind, year, name = collection_kind(c), collection_year(c), collection_name(c)
    return F.when(kind == "subject", F.concat_ws("/", year, F.lit("subject"), name)).when(kind == "sleeping_beauty", F.concat_ws("/", year, F.lit("new"), name)).when(kind == "month", F.concat_ws("/", year, c)).otherwise(c)


def collection_id(path: Col) -> Column:
    """The id of a collection folder {year}/…; null for other paths."""
    p = _c(path)
    year = F.regexp_extract(p, r"^(\d{4})/", 1)
    rest = F.regexp_extract(p, r"^\d{4}/(?:subject/|new/)?([^/]+)$", 1)
    return F.when(p.rlike(r"^\d{4}/subject/[^/]+$"), F.concat(year, F.lit("-subject-"), rest)).when(p.rlike(r"^\d{4}/new/[^/]+$"), F.concat(year, F.lit("-sleeping-"), rest)).when(p.rlike(r"^\d{4}/[^./][^/]*$"), rest)


def thumbnail_path(collection_id: Col, barcode: Col) -> Column:
    b = _c(barcode)
    return F.concat(F.lit("/content/"), collection_path(collection_id), F.lit("/"), b, F.lit("/"), b, F.lit("_thumb.jpg"))


def month_label(collection_id: Col) -> Column:
    """二零二五年 八月 for 2025-08."""
    c = _c(collection_id)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.substring(c, 6, 2).cast("int"))
    return F.concat(F.translate(F.substring(c, 1, 4), "0123456789", DIGITS), F.lit("年 "), month, F.lit("月"))


def seeded_random(seed: Col) -> Column:
    """A number in [0, 1) from a string: a 31-hash in 32 bits, then the fraction of its sine times 10000."""
    letters = F.filter(F.split(_c(seed), ""), lambda x: x != "")
    wrap = lambda h, x: F.pmod(h * 31 + F.ascii(x) + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    h = F.aggregate(letters, F.lit(0).cast("long"), wrap)
    x = F.sin(h.cast("double")) * 10000
    return x - F.floor(x)


def seeded_randoms(seed: Col, count: int) -> Column:
    return F.array(*[seeded_random(F.concat(_c(seed), F.lit(f"-{k}"))) for k in range(count)])


def strip_fence(col: Col) -> Column:
    """Model output without a leading code fence and what closes it."""
    t = trimmed(col)
    bare = F.regexp_replace(F.regexp_replace(t, f"^```json{WHITE}*|^```{WHITE}*", ""), f"{WHITE}*```$", "")
    return F.when(t.startswith("```"), bare).otherwise(t)


def unfence(col: Col) -> Column:
    """Model output inside a code fence that spans all of it; else trimmed only."""
    t = trimmed(col)
    fence = f"(?s)^```(?:json)?{WHITE}*(.*?){WHITE}*```$"
    return F.when(t.rlike(fence), F.regexp_extract(t, fence, 1)).otherwise(t)


def message_text(parts: Col) -> Column:
    """The text parts of array<struct<type, text>>, concatenated."""
    kept = F.filter(_c(parts), lambda p: (p["type"] == "text") & p["text"].isNotNull())
    return F.array_join(F.transform(kept, lambda p: p["text"]), "")


def classifier_prompt(user_input: Col, history: Col) -> Column:
    """The sections of an intent prompt; an empty history is left out."""
    head = F.concat_ws("\n", F.lit("# 当前用户输入"), trimmed(user_input))
    return F.when(first_text(history).isNull(), head).otherwise(F.concat_ws("\n", head, F.lit("\n\n# 历史对话"), _c(history)))


def system_prompt(base: Col, background: Col, results: Col, draft: Col) -> Column:
    """The base prompt and those of background, results and draft that are not empty, blank lines between."""
    return F.concat_ws("\n\n", *[first_text(c) for c in (base, background, results, draft)])


def size_text(size: Col) -> Column:
    """Bytes, KB or MB with two decimals at most; null from a GB on, for which the units have no name."""
    x = _c(size).cast("double")
    k = F.floor(F.log(x) / F.log(F.lit(1024.0))).cast("int")
    value = F.floor(x / F.pow(F.lit(1024.0), k) * 100 + 0.5) / 100
    unit = F.get(F.array(F.lit("Bytes"), F.lit("KB"), F.lit("MB")), k)
    return F.when(x == 0, "0 Bytes").otherwise(F.concat(number_text(value), F.lit(" "), unit))
