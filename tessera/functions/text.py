"""Column functions on strings: tokens, cleaning, noise and quality."""

from pyspark.sql import functions as F

#: Lines shorter than this many letters and without a keyword are noise.
LEAST_LETTERS = 6


def tokens(c):
    """Lower-cased runs of letters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda t: t != "")


def count(c, pattern):
    return F.regexp_count(c, F.lit(pattern))


def meaningful(line, keywords=()):
    """A line with enough letters, or with a keyword."""
    ok = count(line, r"\p{L}") >= LEAST_LETTERS
    for k in keywords:
        ok = ok | line.contains(k)
    return ok


#: Ordered rewrites of raw page text: fixed values of this engine.
REWRITES = ((r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"<[^>]*>", ""), (r"[*#%&$!]{2,}", ""), (r"[ \t]+", " "))


def clean(c, keywords=()):
    """Rewrites in order, then meaningful lines only, trimmed, joined by newlines."""
    for pattern, to in REWRITES:
        c = F.regexp_replace(c, pattern, to)
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: meaningful(x, keywords)), "\n")


def clean_wikitext(c):
    """Piped and plain links to their text, templates to their last part, <br> to a newline, runs of newlines to two."""
    c = F.regexp_replace(c, r"\{\{[^{}|]*\|([^{}|]*)\}\}", "$1")
    c = F.regexp_replace(c, r"\{\{([^{}]*)\}\}", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]]*)\]\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"\n{3,}", "\n\n"))


def empty_after_clean(c):
    """Under 30 characters, or under 3 words of three letters or more."""
    return (F.length(F.trim(c)) < 30) | (count(c, r"\p{L}{3,}") < 3)


def known(c):
    """Trimmed; null and the words none and null are empty."""
    t = F.trim(c)
    return F.when(c.isNull() | F.lower(t).isin("none", "null"), "").otherwise(t)


def quality(c, letters, noise):
    """0.6 * share of letters + 0.5 * min(words a character, 0.3) - min(0.8, 0.15 * noise), within 0 and 1; short texts 0."""
    n = F.length(c)
    score = 0.6 * count(c, letters) / n + 0.5 * F.least(count(c, r"\p{L}{3,}") / n, F.lit(0.3)) - F.least(F.lit(0.8), 0.15 * count(c, noise))
    return F.when(n < 20, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def dialogue_like(c):
    """Five lines or more, and after the first three at least three meaningful ones of which 40 % begin name: ."""
    lines = F.split(c, "\n")
    rest = F.filter(F.slice(lines, 4, F.greatest(F.size(lines), F.lit(1))), lambda x: F.length(F.trim(x)) > 3)
    spoken = F.size(F.filter(rest, lambda x: x.rlike(r"^[^:\s]{1,20}: ")))
    return (F.size(lines) >= 5) & (F.size(rest) >= 3) & (spoken >= 0.4 * F.size(rest))


def html_text(c):
    """Blocks to lines, links to their target, scripts, styles and other tags dropped, five entities resolved, blank lines out."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    c = F.regexp_replace(c, r'(?i)<a [^>]*href="([^"]*)"[^>]*>', " $1 ")
    c = F.regexp_replace(c, r"(?i)<(br|p|/p|div|/div|li|/li|tr|/tr|h[1-6]|/h[1-6])[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), "\n")


def absolute(url, base):
    """//host to https, /path to the base's scheme and host, others as they are."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), url)).otherwise(url)


def links(html):
    """Targets of all links in order, trimmed, without empty ones, each once."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""))


def extension(url, default):
    """The path's extension of 2 to 5 letters or digits, lower-cased, or the default."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[^?#]*/[^/?#]*\.([A-Za-z0-9]{2,5})(?:[?#].*)?$", 1)), F.lit("")), F.lit(default))


def file_name(prefix, c):
    """Unsafe characters as _, none at the ends, unnamed if nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z\p{L}-]+", "_"), r"^_+|_+$", "")
    return F.concat(F.lit(prefix + "_"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("unnamed")))


def bigrams(c):
    """Distinct adjacent pairs of characters; none for less than two."""
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))))


def characters(c):
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def char_jaccard(a, b):
    """Jaccard similarity of character sets; 0 for an empty one."""
    x, y = characters(a), characters(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))
