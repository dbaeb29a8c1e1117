"""Facts from page text: typed dates, ages, cost, format and requirements. A doubtful fact is null, never a guess."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domains as D
from ..functions.dates import lookup, parse_date
from ..functions.patterns import first_kind, first_match, matches
from ..functions.text import collapse, non_blank, sentences, stands_in, title_case, trimmed, verbatim_form


def date_kind(sentence: Column) -> Column:
    return first_kind(sentence, D.DATE_KINDS)


def split_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, sentence): sentences are split once and then handled as rows, so patterns run in generated code."""
    return texts.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def dates(rows: DataFrame, key: str, reference_year: Column | None = None) -> DataFrame:
    """Typed dates of each text: key, pos, kind, date, is_rolling, raw_text; the first sentence of a kind and instant.

    A rolling sentence names its kind, an application deadline if it doesn't,
    and has no instant (1970 stands for it). Other sentences need a purpose and a date.
    """
    s = F.col("sentence")
    # Generators, so that filters do not evaluate the patterns again.
    r = rows.select("*", F.inline(F.array(F.struct(matches(s, D.ROLLING).alias("is_rolling"), date_kind(s).alias("kind")))))
    r = r.withColumn("kind", F.coalesce("kind", F.when(F.col("is_rolling"), "APPLICATION_DEADLINE"))).filter("kind is not null")
    date = F.when(F.col("is_rolling"), F.lit("1970-01-01").cast("timestamp")).otherwise(parse_date(s, reference_year)["date"])
    r = r.select("*", F.explode(F.array(date)).alias("date")).filter("date is not null")
    first = Window.partitionBy(key, "kind", "date", "is_rolling").orderBy("pos")
    return r.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select(key, "pos", "kind", "date", "is_rolling", F.col("sentence").alias("raw_text"))


def age_range(text: Column) -> Column:
    """struct(min, max, raw) of the first form that gives plausible ages; null without one."""
    n = lambda p, k: first_match(text, p, k).try_cast("int")
    fine = lambda x: x.between(5, 99)
    none = F.lit(None).cast("int")
    out = [F.when(fine(n(p, 1)) & fine(n(p, 2)) & (n(p, 1) <= n(p, 2)), F.struct(n(p, 1).alias("min"), n(p, 2).alias("max"), first_match(text, p).alias("raw"))) for p in D.AGE_RANGES]
    under, over = D.AGE_UNDER, D.AGE_OVER
    out.append(F.when(fine(n(under, 1)), F.struct(none.alias("min"), (n(under, 1) - 1).alias("max"), first_match(text, under).alias("raw"))))
    out.append(F.when(fine(n(over, 1)), F.struct(n(over, 1).alias("min"), none.alias("max"), first_match(text, over).alias("raw"))))
    return F.coalesce(*out)


def cost(text: Column) -> Column:
    """struct(cost_type, amount, currency): an amount needs fee wording near it; otherwise free, aid or UNKNOWN."""
    number = lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double")
    before = matches(text, D.FEE_BEFORE)
    symbol = F.coalesce(first_match(text, D.FEE_BEFORE, 1), first_match(text, D.FEE_AFTER, 1))
    amount = F.when(before, number(first_match(text, D.FEE_BEFORE, 2))).otherwise(number(first_match(text, D.FEE_AFTER, 2)))
    code = first_match(text, D.FEE_CODE, 1, ignore_case=False)
    coded = F.when(code.isin(D.CURRENCY_CODES), number(first_match(text, D.FEE_CODE, 2, ignore_case=False)))
    aid, free = matches(text, D.AID), matches(text, D.FREE)
    paid = F.when(aid, "FREE_WITH_AID").otherwise("PAID")
    made = lambda kind, n, c: F.struct(kind.alias("cost_type"), n.cast("double").alias("amount"), c.cast("string").alias("currency"))
    none = F.lit(None)
    return (
        F.when(amount.isNotNull(), made(paid, amount, lookup(D.CURRENCY_SYMBOLS, symbol)))
        .when(coded.isNotNull(), made(paid, coded, code))
        .when(free, made(F.lit("FREE"), none, none))
        .when(aid, made(F.lit("FREE_WITH_AID"), none, none))
        .otherwise(made(F.lit("UNKNOWN"), none, none))
    )


def attendance(text: Column) -> Column:
    place, net = matches(text, D.IN_PERSON), matches(text, D.ONLINE)
    return F.when(matches(text, D.HYBRID) | (place & net), "HYBRID").when(place, "IN_PERSON").when(net, "ONLINE").otherwise("UNKNOWN")


def requirements(rows: DataFrame, key: str) -> DataFrame:
    """(key, label, raw_text): phrases of sentences, each label with the first sentence it is in."""
    found = F.array(*[F.struct(F.lit(i).alias("p"), first_match(F.col("sentence"), p, 0, i_case).alias("m")) for i, (p, i_case) in enumerate(D.REQUIREMENTS)])
    hits = rows.select(key, "pos", "sentence", F.inline(found)).filter("m is not null").withColumn("label", title_case(F.col("m")))
    first = Window.partitionBy(key, F.lower("label")).orderBy("pos", "p")
    return hits.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select(key, "label", F.col("sentence").alias("raw_text"))


def markup_first(markup: DataFrame, text: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """Dates that the markup gives, and those of the text whose kind it gives none of on the same page."""
    return markup.unionByName(text.join(markup.select(key, kind).distinct(), [key, kind], "left_anti"))


def gaps(**facts: Column) -> Column:
    """Names of facts that are missing, in the order given."""
    return F.filter(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in facts.items()]), lambda x: x.isNotNull())


#: Lists of a model's answer are read up to these lengths.
MOST_REQUIREMENTS, MOST_BENEFITS = 10, 8


def fill_gaps(pages: DataFrame, answers: DataFrame, key: str, year: Column | None = None) -> DataFrame:
    """Facts of pages, with what a model's answer adds to them and what of it was turned down.

    ``pages`` has text and the facts found so far: title, summary, organizer, format, deadline, age_min,
    age_max, cost_type, cost_amount, cost_currency and the array requirements; ``answers`` has title, summary, organizer, format,
    deadline_text, age_min, age_max, age_text, cost_text and the arrays requirements and benefits. Only pages of 200
    characters or more are filled. A quotation must stand in the page; a format is a choice of three and needs
    none. Dates and costs are read again from the quotation. What the page gave is never replaced.
    Adds ``benefits`` and ``rejected``, the fields whose quotation or second reading failed, in order.
    """
    names = ["title", "summary", "organizer", "format", "deadline_text", "age_min", "age_max", "age_text", "cost_text", "requirements", "benefits"]
    r = pages.join(answers.select(key, *[F.col(f).alias(f"_said_{f}") for f in names]), key, "left")
    said = lambda f: F.col(f"_said_{f}")
    # Each step stands behind a generator, so it is made once a page and not wherever it is used.
    step = lambda df, **made: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
    here = lambda v: stands_in(v, F.col("_form"))
    quote = {"title": "title", "summary": "summary", "organizer": "organizer", "deadline": "deadline_text", "age": "age_text", "cost": "cost_text"}
    list_of = lambda f, n: F.slice(F.filter(F.coalesce(said(f), F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0), 1, n)
    open_, given = F.col("_open"), lambda f: F.col(f"_given_{f}")
    r = step(r, _form=verbatim_form(F.col("text")), _open=F.coalesce(F.length("text") >= 200, F.lit(False)), **{f"_given_{f}": non_blank(said(q)) for f, q in quote.items()})
    missing = {f: F.col(f).isNull() for f in ("title", "summary", "organizer", "deadline")} | {"age": F.col("age_min").isNull() & F.col("age_max").isNull(), "cost": F.col("cost_type").isNull()}
    r = step(r, _no_needs=open_ & (F.coalesce(F.size("requirements"), F.lit(0)) <= 0), **{f"_asked_{f}": open_ & missing[f] & given(f).isNotNull() for f in quote})
    asked, no_needs = {f: F.col(f"_asked_{f}") for f in quote}, F.col("_no_needs")
    looked = lambda test, texts: F.when(test, F.transform(texts, lambda x: F.struct(x.alias("text"), here(x).alias("here"))))
    lists = {"_needs": looked(no_needs, list_of("requirements", MOST_REQUIREMENTS)), "_gains": looked(open_, list_of("benefits", MOST_BENEFITS))}
    r = step(r, **lists, **{f"_quoted_{f}": F.when(asked[f], here(given(f))).otherwise(False) for f in quote})
    quoted = {f: F.col(f"_quoted_{f}") for f in quote}
    r = step(r, _date=F.when(quoted["deadline"], parse_date(given("deadline"), year)["date"]), _price=F.array(F.when(quoted["cost"], cost(given("cost")))))
    date, price = F.col("_date"), F.get("_price", F.lit(0))
    priced = F.coalesce(price["cost_type"] != "UNKNOWN", F.lit(False))
    texts = lambda name, test: F.transform(F.filter(name, test), lambda x: x["text"])
    bad = [F.when(asked[f] & ~quoted[f], F.lit(f)) for f in ("title", "summary", "organizer")]
    bad.append(F.when(asked["deadline"] & date.isNull(), F.lit("deadline")))
    bad += [F.when(asked[f] & ~quoted[f], F.lit(f)) for f in ("age", "cost")]
    listed = [F.transform(texts(v, lambda x: ~x["here"]), lambda x: F.concat(F.lit(f"{f}: "), x)) for f, v in (("requirement", "_needs"), ("benefit", "_gains"))]
    empty = F.array().cast("array<string>")
    return r.select(
        key,
        *[F.coalesce(F.col(f), F.when(quoted[f], given(f))).alias(f) for f in ("title", "summary", "organizer")],
        F.coalesce("format", F.when(open_ & said("format").isin("ONLINE", "IN_PERSON", "HYBRID"), said("format"))).alias("format"),
        F.coalesce("deadline", date).alias("deadline"),
        *[F.coalesce(f, F.when(quoted["age"], said(f))).alias(f) for f in ("age_min", "age_max")],
        *[F.coalesce(F.col(c), F.when(priced, price[p])).alias(c) for c, p in (("cost_type", "cost_type"), ("cost_amount", "amount"), ("cost_currency", "currency"))],
        F.when(no_needs, texts("_needs", lambda x: x["here"])).otherwise(F.col("requirements")).alias("requirements"),
        F.coalesce(texts("_gains", lambda x: x["here"]), empty).alias("benefits"),
        F.concat(F.filter(F.array(*bad), lambda x: x.isNotNull()), *[F.coalesce(x, empty) for x in listed]).alias("rejected"),
    )


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p) for p in patterns])


def page_text(text: Column) -> Column:
    return trimmed(collapse(text))


def one_per_day(deadlines: DataFrame, key: str, order: str) -> DataFrame:
    """The first deadline of each kind and UTC day, rolling ones included."""
    w = Window.partitionBy(key, "kind", F.to_date("date")).orderBy(order)
    return deadlines.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
