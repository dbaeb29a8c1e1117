"""HTML and JSON-LD reader: pages to raw facts, a few pages at a time.

Only the parsing is Python, by the tokenizer of `markup`; what the
facts mean is decided by column expressions afterwards.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, non_blank
from .markup import Markup

#: Elements whose text is not page text.
DROPPED = {"script", "style", "noscript", "svg", "nav", "footer", "header", "form"}
#: JSON-LD types that describe an opportunity.
TYPES = {"Event", "EducationEvent", "Course", "CourseInstance", "EducationalOccupationalProgram", "Scholarship", "JobPosting", "Grant", "MonetaryGrant"}
FIELDS = ["name", "description", "startDate", "endDate", "applicationDeadline", "applicationStartDate", "validThrough"]
#: What is read of a page.
SCHEMA = "title string, og_title string, og_description string, body string, ld_name string, ld_description string, ld_start string, ld_end string, ld_deadline string, ld_opens string, ld_valid_through string, ld_price string, ld_currency string, ld_mode string"


class Reader(Markup):
    def __init__(self, html: str):
        self.stack: list[str] = []
        self.ld, self.meta, self.title, self.body = [], {}, [], []
        self.read(html)

    def handle_starttag(self, tag, attrs):
        a = attrs
        if tag == "meta":
            self.meta.setdefault(a.get("property") or a.get("name") or "", a.get("content"))
        elif tag == "title":
            self.stack.append("title")
        elif tag in DROPPED:
            self.stack.append("ld" if tag == "script" and a.get("type") == "application/ld+json" else tag)
        else:
            self.body.append(" ")

    def handle_endtag(self, tag):
        if tag in DROPPED or tag == "title":
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k] == tag or (tag == "script" and self.stack[k] == "ld"):
                    del self.stack[k:]
                    break
        else:
            self.body.append(" ")

    def handle_data(self, data):
        if not self.stack:
            self.body.append(data)
        elif self.stack[-1] == "ld":
            self.ld.append(data)
        elif self.stack[-1] == "title":
            self.title.append(data)


def nodes(blocks: list[str]) -> list[dict]:
    """Opportunity nodes of JSON-LD blocks, breadth first; children in @graph are queued, broken and bottomless blocks skipped."""
    out, queue = [], deque()
    for b in blocks:
        try:
            queue.append(json.loads(b))
        except (ValueError, RecursionError):
            continue
    while queue:
        x = queue.popleft()
        if isinstance(x, list):
            queue.extend(x)
        elif isinstance(x, dict):
            kinds = x.get("@type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if any(k in TYPES for k in kinds):
                out.append(x)
            queue.extend(x.get("@graph") or [] if isinstance(x.get("@graph"), list) else [])
    return out


def _text(v) -> str | None:
    if isinstance(v, bool) or v is None:
        return None
    return str(v) if isinstance(v, (str, int, float)) else None


def _facts(html: str) -> list[str | None]:
    r = Reader(html)
    first: dict[str, str | None] = {}
    offers: dict = {}
    for n in nodes(r.ld):
        for f in [*FIELDS, "eventAttendanceMode", "courseMode"]:
            if first.get(f) is None:
                first[f] = _text(n.get(f))
        o = n.get("offers")
        o = o[0] if isinstance(o, list) and o else o
        if isinstance(o, dict) and not offers:
            offers = o
    return ["".join(r.title), r.meta.get("og:title"), r.meta.get("og:description") or r.meta.get("description"), "".join(r.body), *[first.get(f) for f in FIELDS], _text(offers.get("price")), _text(offers.get("priceCurrency")), first.get("eventAttendanceMode") or first.get("courseMode")]


def read(pages: DataFrame) -> DataFrame:
    """Raw facts of each page (page_id, html): see `SCHEMA`. Null html gives empty facts.

    Pages go to Python a hundred at a time, as rows do without Arrow, so how much it holds hangs on a
    page's size and neither on their number nor on the session's Arrow batches.
    """
    facts = F.udf(lambda html: _facts(html or ""), SCHEMA, useArrow=False)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), facts("html").alias("facts")).select("page_id", "facts.*")


def number(text: Column) -> Column:
    """A number, possibly between other words; never from an empty text."""
    n = F.regexp_extract(F.trim(text), r"^[^\d.,-]*(-?\d[\d,]*(?:\.\d+)?)[^\d]*$", 1)
    return F.replace(F.nullif(n, F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def attendance_mode(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("mixed|hybrid|blended"), "HYBRID").when(t.rlike("offline|in[-_ ]?person|onsite"), "IN_PERSON").when(t.rlike("online"), "ONLINE")


def facts(raw: DataFrame) -> DataFrame:
    """Facts and how they are known: markup first, then OpenGraph, then the page's title and text."""
    title = F.coalesce(non_blank(F.col("ld_name")), non_blank(F.col("og_title")), non_blank(collapse(F.col("title"))))
    method = F.when(non_blank(F.col("ld_name")).isNotNull() | non_blank(F.col("og_title")).isNotNull(), "STRUCTURED_MARKUP").when(title.isNotNull(), "LABELLED_PAGE_TEXT")
    price = number(F.col("ld_price"))
    return raw.select(
        "page_id",
        title.alias("title"),
        method.alias("title_method"),
        F.coalesce(non_blank(F.col("ld_description")), non_blank(F.col("og_description"))).alias("summary"),
        F.trim(collapse(F.col("body"))).alias("text"),
        F.when(price == 0, "FREE").when(price > 0, "PAID").alias("cost_type"),
        F.when(price > 0, price).alias("cost_amount"),
        F.when(price > 0, non_blank(F.col("ld_currency"))).alias("cost_currency"),
        attendance_mode(F.col("ld_mode")).alias("format"),
        *[F.col(c).try_cast("timestamp").alias(n) for c, n in (("ld_deadline", "application_deadline"), ("ld_start", "program_start"), ("ld_end", "program_end"), ("ld_opens", "application_opens"))],
    )
