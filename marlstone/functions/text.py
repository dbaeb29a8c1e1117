"""Text, URL, hash and label functions: Column -> Column, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import domains as D
from .patterns import matches

_SPACE = r"[\s\u00a0\ufeff\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u1680]+"


#: A white space other than a single blank.
_WIDE = r" {2}|[\t-\r\u00a0\ufeff\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u1680]"


def collapse(text: Column) -> Column:
    return F.when(text.rlike(_WIDE), F.regexp_replace(text, _SPACE, " ")).otherwise(text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def non_blank(text: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def humanise(slug: Column) -> Column:
    return F.translate(slug, "-_", "  ")


def humanise_lower(slug: Column) -> Column:
    return F.lower(humanise(slug))


def humanise_capital(slug: Column) -> Column:
    h = humanise(slug)
    return F.concat(F.upper(F.substring(h, 1, 1)), F.substring(h, 2, 1 << 30))


def title_case(text: Column) -> Column:
    t = F.lower(trimmed(text))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def slug_ascii(text: Column) -> Column:
    """Profile slugs: runs of anything but a-z and 0-9 become one hyphen, none at the ends; null under two characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(trimmed(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(s) >= 2, s)


def _decomposed(text: Column) -> Column:
    import unicodedata

    import pyarrow as pa

    def nfkd(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFKD", x) for x in t.to_pylist()], pa.string())

    nfkd.__annotations__ = {"t": pa.Array, "return": pa.Array}
    return F.arrow_udf(nfkd, "string")(text)


def slugify(title: Column, suffix: Column) -> Column:
    """Listing slug: compatibility-decomposed letters and digits of any script, at most 60 characters, and six of the suffix.

    Decomposition is the one step that Spark has no function for.
    """
    s = _decomposed(F.lower(title))
    s = F.regexp_replace(s, r"[^\p{L}\p{N}\s-]", "")
    s = F.regexp_replace(F.regexp_replace(trimmed(s), r"\s+", "-"), "-+", "-")
    s = F.substring(F.regexp_replace(s, "^-|-$", ""), 1, 60)
    return F.concat(F.when(s == "", F.lit("opportunity")).otherwise(s), F.lit("-"), F.substring(suffix, 1, 6))


def slugs(texts: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(texts, slug_ascii), lambda x: x.isNotNull())), 1, most)


def normalise_title(title: Column) -> Column:
    t = F.replace(F.translate(F.lower(title), "‘’“”", "''''"), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, r"[^a-z0-9\s]", " ")
    t = F.regexp_replace(t, r"\b(19|20)\d{2}\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title_tokens(normal: Column) -> Column:
    """Distinct tokens of a normalised title that tell titles apart."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: (F.length(w) > 2) & ~w.isin(D.TITLE_STOPWORDS)))


def trigrams(normal: Column) -> Column:
    padded = F.concat(F.lit("  "), normal, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct elements."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def host(url: Column) -> Column:
    """Host name without ``www.``, lower case; empty where the text is no absolute URL."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def host_label(url: Column) -> Column:
    return F.coalesce(F.nullif(host(url), F.lit("")), F.lit("Unknown organiser"))


def canonical_url(url: Column) -> Column:
    """No fragment and no tracking parameters, parameters by name, no trailing slash, host lower case without ``www.``.

    What is no absolute URL comes back as it is. Parameter values are not
    encoded anew: URLs that only differ in escapes stay different.
    """
    head = r"^([A-Za-z][A-Za-z0-9+.\-]*)://((?:[^/?#@]*@)?)([^/?#:]+)((?::\d+)?)([^?#]*)(?:\?([^#]*))?"
    part = lambda k: F.regexp_extract(url, head, k)
    pairs = F.filter(F.split(part(6), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(D.TRACKING_PARAMETERS))
    # Stable by name: position breaks ties.
    keyed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    path = F.regexp_replace(F.when(part(5) == "", F.lit("/")).otherwise(part(5)), "^(.+)/$", "$1")
    out = F.concat(F.lower(part(1)), F.lit("://"), part(2), F.regexp_replace(F.lower(part(3)), r"^www\.", ""), part(4), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(head), out).otherwise(url)


def is_official(domain: Column) -> Column:
    return ~domain.isin(D.AGGREGATORS) & domain.rlike("(?i)" + "|".join(D.OFFICIAL_SUFFIXES))


def source_tier(domain: Column, blocked: tuple[str, ...] = ()) -> Column:
    tier = F.when(is_official(domain), 3).when(domain.isin(D.AGGREGATORS), 1).otherwise(2)
    return F.when(domain.isin(*blocked), 0).otherwise(tier) if blocked else tier


def decode_entities(text: Column) -> Column:
    """Search-hit markup: emphasis tags off, then the seven references in this order."""
    t = F.regexp_replace(text, "(?i)</?strong>", "")
    for ref, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(ref), F.lit(char))
    return t


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def sentences(text: Column) -> Column:
    """Sentences of white-space-collapsed text: after . ! ? ; and a blank, and before a bullet."""
    parts = F.split(collapse(text), r"(?<=[.!?;])\s+|(?=•)")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def verbatim_form(text: Column) -> Column:
    """Text as quotations are compared: no matter of case, white space, or kind of quote and dash."""
    return trimmed(collapse(F.translate(F.lower(text), "‘’“”\"–—", "'''''--")))


def stands_in(needle: Column, form: Column) -> Column:
    """`appears_verbatim` in a text of which the `verbatim_form` is made already."""
    # An array of one, so that the needle's form is made once.
    return F.coalesce(F.exists(F.array(verbatim_form(needle)), lambda n: (F.length(n) >= 3) & F.contains(form, n)), F.lit(False))


def appears_verbatim(needle: Column, text: Column) -> Column:
    return stands_in(needle, verbatim_form(text))


def escape_ics(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([,;\\])", r"\\$1"), F.lit("\n"), F.lit("\\n"))


def escape_html(text: Column) -> Column:
    """Text for the inside of an element or a quoted attribute."""
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def violates_claims(text: Column) -> Column:
    return matches(text, "|".join(D.BANNED_CLAIMS))


def same_loosely(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def in_loosely(values: Column, needle: Column) -> Column:
    return F.exists(values, lambda x: same_loosely(x, needle))


def ipv4_number(address: Column) -> Column:
    """The address as a number, null where it is none."""
    p = F.split(address, r"\.")
    n = lambda i: F.get(p, F.lit(i)).cast("long")
    value = ((n(0) * 256 + n(1)) * 256 + n(2)) * 256 + n(3)
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(address.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), value)


def blocked_reason(address: Column) -> Column:
    """Why an IP address must not be fetched; null for public addresses and for host names."""
    low = F.regexp_replace(F.lower(address), r"^\[|\]$", "")
    mapped = F.nullif(F.regexp_extract(low, r"^::ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1), F.lit(""))
    four = F.coalesce(mapped, address)
    value = ipv4_number(four)
    out = F.lit(None).cast("string")
    for base, bits, reason in reversed(D.BLOCKED_RANGES):
        a, b, c, d = map(int, base.split("."))
        first = ((a * 256 + b) * 256 + c) * 256 + d
        out = F.when(value.between(first, first + (1 << (32 - bits)) - 1), F.lit(reason)).otherwise(out)
    v4 = F.when(four == D.METADATA_ADDRESS, F.lit("CLOUD_METADATA")).otherwise(out)
    v6 = (
        F.when(low == "::1", "LOOPBACK").when(low == "::", "UNSPECIFIED").when(low.rlike("^f[cd][0-9a-f]{2}:"), "UNIQUE_LOCAL")
        .when(low.rlike("^fe[89ab][0-9a-f]:"), "LINK_LOCAL").when(low.rlike("^ff[0-9a-f]{2}:"), "MULTICAST")
    )
    return F.when(value.isNotNull(), v4).otherwise(v6)


def blocked_host(hostname: Column) -> Column:
    h = F.regexp_replace(F.lower(hostname), r"\.$", "")
    named = (
        F.when(h.isin("metadata.google.internal", "metadata"), "CLOUD_METADATA")
        .when((h == "localhost") | h.endswith(".localhost"), "LOOPBACK")
        .when(h.endswith(".internal") | h.endswith(".local"), "PRIVATE")
    )
    return F.coalesce(named, blocked_reason(h))


def parent_email_problem(parent: Column, student: Column) -> Column:
    v = F.lower(trimmed(parent))
    return (
        F.when(F.length(v) == 0, "Enter an email address for your parent or guardian.")
        .when(F.length(v) > 254, "That email address is too long.")
        .when(~v.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), "That does not look like an email address.")
        .when(v == F.lower(trimmed(student)), "That is your own address. Consent has to come from your parent or guardian.")
    )


def cost_label(cost_type: Column, amount: Column, currency: Column) -> Column:
    shown = F.when(amount == F.floor(amount), amount.cast("long").cast("string")).otherwise(amount.cast("string"))
    priced = F.trim(F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), shown))
    return F.when(cost_type == "FREE", "Free").when(cost_type == "FREE_WITH_AID", "Paid, aid available").when((cost_type == "PAID") & amount.isNotNull(), priced).otherwise("Not stated")
