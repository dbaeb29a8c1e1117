"""robots.txt rules of many sites at once: the body as lines, folded per site in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rules(body: Column, agent: str) -> Column:
    """struct(allow, disallow, delay_ms) for ``agent``, in lower case; a group naming it overrides those of ``*``.

    Crawl delays are capped at ten seconds.
    """
    line = F.transform(F.split(body, r"\r?\n"), lambda s: F.trim(F.substring_index(s, "#", 1)))
    fields = F.transform(F.filter(line, lambda s: s != ""), lambda s: F.struct(F.lower(F.trim(F.substring_index(s, ":", 1))).alias("f"), F.trim(F.when(F.contains(s, F.lit(":")), F.substring(s, F.instr(s, ":") + 1, F.length(s))).otherwise("")).alias("v")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("allow"), none.alias("disallow"), F.lit(0.0).alias("delay_ms"), F.lit(False).alias("applies"), F.lit(False).alias("own"))

    def step(s: Column, x: Column) -> Column:
        value = F.lower(x["v"])
        opens, mine = x["f"] == "user-agent", (x["f"] == "user-agent") & (value == agent)
        fresh = mine & ~s["own"]
        add = lambda field, old: F.when(fresh, none).when(s["applies"] & (x["f"] == field) & (x["v"] != ""), F.concat(old, F.array(x["v"]))).otherwise(old)
        delay = F.regexp_extract(x["v"], r"^-?\d+(?:\.\d+)?", 0).try_cast("double")
        return F.struct(
            add("allow", s["allow"]).alias("allow"),
            add("disallow", s["disallow"]).alias("disallow"),
            F.when(s["applies"] & (x["f"] == "crawl-delay") & delay.isNotNull(), F.least(delay * 1000, F.lit(10_000.0))).otherwise(s["delay_ms"]).alias("delay_ms"),
            F.when(opens, mine | ((value == "*") & ~s["own"])).otherwise(s["applies"]).alias("applies"),
            (s["own"] | mine).alias("own"),
        )

    return F.aggregate(fields, start, step, lambda s: F.struct(s["allow"], s["disallow"], s["delay_ms"]))


def allows(rules_: Column, path: Column) -> Column:
    """Whether a path may be fetched: the longest prefix wins, allow wins ties."""

    def best(patterns: Column) -> Column:
        prefixes = F.transform(patterns, lambda p: F.regexp_replace(p, r"\*$", ""))
        return F.coalesce(F.array_max(F.transform(F.filter(prefixes, lambda p: F.startswith(path, p)), F.length)), F.lit(-1))

    return (best(rules_["disallow"]) < 0) | (best(rules_["allow"]) >= best(rules_["disallow"]))
