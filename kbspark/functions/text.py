"""String functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks, in lower case, and the letters they fold to; marks that stand alone go.
_FOLDED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c == c.lower() and unicodedata.decomposition(c)}
_FOLDED = {c: base for c, base in _FOLDED.items() if base.isascii() and base.isalpha()}
MARKED = "".join(_FOLDED) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(_FOLDED.values())

# Words that queries drop.
QUERY_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "does", "for", "from", "has", "have", "how", "if", "in", "is", "it", "its", "of", "on", "or", "so", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "will", "with")

# Words that title comparison drops.
TITLE_STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "are", "was", "has", "have", "its", "can", "how", "new", "via", "using", "based", "learning", "test", "time", "model", "models")

# Shapes of secrets, in their order, and whether group 1 is a prefix that stays.
SECRET_PATTERNS = (
    (r"(?i)(Bearer\s+)[A-Za-z0-9\-._~+/]+=*", True),
    (r"(?i)(Authorization:\s*token\s+)\S+", True),
    (r"(?:ghp_|gho_|ghu_|ghs_|ghr_|github_pat_)[A-Za-z0-9_]{20,}", False),
    (r"sk-ant-[A-Za-z0-9\-]{20,}", False),
    (r"sk-[A-Za-z0-9]{20,}", False),
    (r"(?i)([?&](?:api_key|apikey|access_token|token)=)[^&\s]+", True),
    (r"(?i)(password\s*[=:]\s*)[^\s,;\"']+", True),
    (r"(?i)(client_secret\s*[=:]\s*)[^\s,;\"']+", True),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", False),
    (r"(AKIA|ASIA)[A-Z0-9]{16}", True),
)
REDACTED = "[REDACTED]"

# Sentence shapes that give subject, predicate and object, in their order.
SENTENCES = (
    r"^(.+?)\s+(uses?|is|are|has|have)\s+(.+)$",
    r"^(.+?)\s+(was|were|moved to|depends on|relies on)\s+(.+)$",
    r"^(.+?)\s+(at|in|on|for)\s+(.+)$",
)

# Markers of paid posts.
PAYWALLS = ("this post is for paid subscribers", "subscribe to read", "become a member to read", "this content is for subscribers only", "unlock this post")

# Fixed value: a footnote definition. Groups: number, file, page, quote.
FOOTNOTE = r"""^\[\^(\d+)\]:\s*([^\s,—]+)(?:,\s*p\.?\s*(\d+))?(?:\s*(?:—|--)\s*"([^"]+)")?\s*$"""


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def trimmed(c: Column) -> Column:
    r"""The same as `strip`, looking at the ends only; `c` is named more than once.

    Its pattern's $ also matches before a last separator that \s doesn't take; such texts go to the pattern.
    """
    separated = reduce(lambda a, b: a | b, (c.endswith(x) for x in "\x85\u2028\u2029"))
    return F.when(separated, strip(c)).otherwise(F.btrim(c, F.lit(" \t\n\x0b\f\r")))


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def tokenize(c: Column) -> Column:
    """Lower-cased words of letters and digits, without marks."""
    return F.filter(F.split(F.translate(F.lower(c), MARKED, PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(text: Column) -> Column:
    """Distinct terms of a query: ASCII words of two letters or more that aren't stop words; any of them matches.

    A word with dashes is a phrase: its tokens, with a space between them, match where they follow one another.
    """
    words = F.split(F.regexp_replace(text, r"[^a-zA-Z0-9\s-]", " "), r"\s+")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*QUERY_STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(kept, lambda w: F.array_join(tokenize(w), " ")), lambda t: t != ""))


def spaced(c: Column) -> Column:
    """The tokens as one text with a space before and after each, so that a term can be looked for without lambdas."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))


def spaced_term(term: str) -> str:
    return f" {term.replace(' ', '  ')} "


def occurrences(text: Column, part: str) -> Column:
    """How many times `part` stands in `text`, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def footnotes(content: Column) -> Column:
    """array<struct<footnote_id, source_file, page_hint, quote, line_no>> of a page's definitions."""
    numbered = F.transform(lines(content), lambda x, i: F.struct(x.alias("line"), i.alias("line_no")))
    part = lambda x, g: F.regexp_extract(x["line"], FOOTNOTE, g)
    return F.transform(
        F.filter(numbered, lambda x: x["line"].rlike(FOOTNOTE)),
        lambda x: F.struct(part(x, 1).alias("footnote_id"), part(x, 2).alias("source_file"), nonempty(part(x, 3)).cast("int").alias("page_hint"), nonempty(part(x, 4)).alias("quote"), x["line_no"].alias("line_no")),
    )


def quote_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def title(content: Column) -> Column:
    """Of the '# ' headings in the first 50 lines: one that starts with 'Title:', else the longest, the first of equals."""
    stripped = F.transform(F.slice(lines(trimmed(content)), 1, 50), trimmed)
    heads = F.transform(F.filter(stripped, lambda x: x.startswith("# ") & (F.length(x) > 3)), lambda x: strip(F.regexp_replace(x, "^#+", "")))
    heads = F.filter(heads, lambda h: (h != "") & ~h.startswith("-") & ~h.startswith("["))
    named = F.get(F.filter(heads, lambda h: F.lower(h).startswith("title:")), F.lit(0))
    longest = F.array_max(F.transform(heads, lambda h, i: F.struct(F.length(h).alias("n"), (-i).alias("i"), h.alias("h"))))["h"]
    return F.coalesce(strip(F.substring(named, 7, 1 << 30)), longest)


def representative_quote(content: Column) -> Column:
    """The first line of more than 30 characters that is prose; over 100, up to the first full stop after the 60th."""
    stripped = F.transform(lines(trimmed(content)), trimmed)
    found = F.get(F.filter(stripped, lambda x: (F.length(x) > 30) & ~F.substring(x, 1, 1).isin("#", ">", "[")), F.lit(0))

    def clipped(first: Column) -> Column:
        stop = F.locate(".", first, 61)
        return F.when(F.length(first) <= 100, first).when(stop > 0, F.substring(first, F.lit(1), stop)).otherwise(F.substring(first, 1, 100))

    return let(found, clipped)


def slug(c: Column, cap: int = 64, empty: str = "untitled") -> Column:
    """Lower case, everything else than letters and digits to single dashes, at most `cap` long."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(nonempty(F.regexp_replace(F.substring(dashed, 1, cap), "-+$", "")), F.lit(empty))


def word_slug(c: Column, cap: int = 1 << 30, empty: str = "unknown") -> Column:
    """Lower case, other characters than letters, digits, spaces and dashes gone, spaces to dashes."""
    kept = F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", "")
    return F.coalesce(nonempty(F.substring(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "^-+|-+$", ""), 1, cap)), F.lit(empty))


_REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def html_unescape(c: Column) -> Column:
    """Character references by number and by the names of HTML 4 replaced, each once; others stay as they are."""
    named = F.create_map(*(F.lit(x) for name, code in (*name2codepoint.items(), ("apos", 39)) for x in (name, chr(code))))

    def decoded(ref: Column) -> Column:
        digits = F.when(ref.rlike("^#[xX]"), F.substring(ref, 3, 6)).when(ref.startswith("#"), F.hex(F.substring(ref, 2, 7).try_cast("long")))
        code = F.conv(digits, 16, 10).try_cast("long")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(F.try_element_at(named, ref), F.when(valid, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")))

    parts = F.arrays_zip(F.split(c, _REFERENCE).alias("gap"), F.regexp_extract_all(c, F.lit(_REFERENCE), 1).alias("ref"))
    shown = lambda p: F.concat(p["gap"], F.coalesce(decoded(p["ref"]), F.concat(F.lit("&"), p["ref"], F.lit(";")), F.lit("")))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, shown), "")).otherwise(c)


def html_title(html: Column) -> Column:
    found = strip(html_unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), found).otherwise("Untitled")


#: A pattern of SECRET_PATTERNS that tries every start anew within a run, and one that takes the same spans in time in proportion to the text.
_R = "[A-Za-z0-9_-]"
_IN_PROPORTION = {
    SECRET_PATTERNS[8]: (rf"(?<!{_R})(?={_R}*+\.eyJ{_R}{{10,}}+\.{_R}{{10}})({_R}*?)eyJ{_R}{{10,}}+\.eyJ{_R}{{10,}}+\.{_R}{{10,}}+", True),
}


def redact(c: Column, extra_patterns: tuple[tuple[str, bool], ...] = ()) -> Column:
    """Secrets replaced, in the patterns' order; where group 1 is a prefix, it stays."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], ("$1" if p[1] else "") + REDACTED.replace("[", "\\[").replace("]", "\\]")), (*(_IN_PROPORTION.get(p, p) for p in SECRET_PATTERNS), *extra_patterns), c)


def strip_dangerous_links(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\[([^\]]*)\]\((javascript|data|vbscript):[^)]*\)", "$1")


def strip_email_chrome(c: Column) -> Column:
    """Without tracking pixels and the elements of unsubscribe and view-in-browser links."""
    out = F.regexp_replace(c, r"""<img[^>]+(?:width|height)\s*=\s*["']?1["']?[^>]*>""", "")
    out = F.regexp_replace(out, r"(?is)<[^>]*(?:unsubscribe|manage.preferences|opt.out)[^>]*>.*?</[^>]+>", "")
    return F.regexp_replace(out, r"(?is)<[^>]*(?:view.in.browser|view.online|read.online)[^>]*>.*?</[^>]+>", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def source_kind(path: Column) -> Column:
    p = F.lower(path)
    paper = reduce(lambda a, b: a | b, (p.contains(d) for d in ("arxiv.org", "openreview.net", "proceedings.", "semanticscholar.org")))
    end = suffix(path)
    return (
        F.when(p.contains("conversations/"), "conversation")
        .when(paper, "paper")
        .when(end.isin(".py", ".ts", ".js", ".rs", ".go", ".tf", ".yml", ".yaml"), "code")
        .when(end == ".pdf", "paper")
        .when(p.contains("raw/web/"), "web")
        .when(end.isin(".md", ".txt", ".rst"), "manual")
        .otherwise("unknown")
    )


def ai_authored(path: Column) -> Column:
    return source_kind(path) == "conversation"


def topic_of_file(path: Column) -> Column:
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(parent.isin("", ".", "local", "raw"), "concepts").otherwise(parent)


def topic_in_repository(relative: Column, repository: Column) -> Column:
    name = F.split(repository, "-")[0]
    folders = F.filter(F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")) - 1), lambda p: ~p.isin("src", "lib", "pkg", "cmd", "internal", "app"))
    return F.when(F.size(folders) > 0, F.concat(name, F.lit("/"), F.get(folders, F.lit(0)))).otherwise(name)


def spo(statement: Column) -> Column:
    """struct<subject, predicate, object> by the first sentence shape that fits, else nulls."""
    low = F.lower(statement)

    def part(g: int, cap: int) -> Column:
        found = F.coalesce(*(F.when(low.rlike(p), F.regexp_extract(low, p, g)) for p in SENTENCES))
        return F.substring(strip(found), 1, cap)

    return F.struct(part(1, 100).alias("subject"), part(2, 100).alias("predicate"), part(3, 200).alias("object"))


def recency(at: Column, now: Column, half_life_hours: float = 168.0) -> Column:
    """1 for now and the future, halved every half-life; 0 for null."""
    hours = (now.cast("long") - at.cast("long")) / 3600.0
    return F.coalesce(F.when(hours <= 0, F.lit(1.0)).otherwise(F.exp(-hours * F.lit(0.6931471805599453) / half_life_hours)), F.lit(0.0))


def belief_score(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(F.lit(5.0)))


def title_words(c: Column) -> Column:
    words = F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z]{3,})"), 1), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*TITLE_STOP_WORDS)))


def title_overlap(a: Column, b: Column) -> Column:
    """Shared words over those of the shorter title; 0 where a title has none."""
    x, y = title_words(a), title_words(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.when(F.least(F.size(x), F.size(y)) > 0, F.least(F.size(x), F.size(y))), F.lit(0.0))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def youtube_id(url: Column) -> Column:
    return F.when(host(url).isin("www.youtube.com", "youtube.com", "m.youtube.com"), nonempty(F.regexp_extract(url, r"[?&]v=([^&#]+)", 1))).when(host(url) == "youtu.be", F.split(F.regexp_replace(url_path(url), "^/+", ""), "/")[0])


def title_from_url(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(url_path(url), "^/+|/+$", ""), "/"), -1)
    spaced = F.replace(F.translate(last, "-_", "  "), F.lit(".pdf"), F.lit(""))
    return F.coalesce(nonempty(F.initcap(spaced)), F.lit("Untitled"))


def url_slug(url: Column) -> Column:
    path = F.translate(F.regexp_replace(url_path(url), "^/+|/+$", ""), "/", "-")
    joined = F.lower(F.concat(F.replace(host(url), F.lit("www."), F.lit("")), F.lit("-"), path))
    return F.coalesce(nonempty(F.substring(F.regexp_replace(joined, "[^a-z0-9-]", ""), 1, 80)), F.lit("page"))


def clean_pdf_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"(\w)-\s*\n\s*(\w)", "$1$2"))


def progress_pct(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * done / total, 1)).otherwise(0.0)


def references(c: Column) -> Column:
    """'#n' and 'PR n' as numbers with '#', and commit hashes of 7 to 40 digits that hold a letter and a digit."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"(?:#|PR\s+#?)(\d+)"), 1), lambda n: F.concat(F.lit("#"), n))
    hashes = F.filter(F.regexp_extract_all(c, F.lit(r"\b([0-9a-f]{7,40})\b"), 1), lambda h: h.rlike("[a-f]") & h.rlike("[0-9]"))
    return F.array_sort(F.array_union(numbers, hashes))


def usd(tokens_in: Column, tokens_out: Column, cache_read: Column | None = None, cache_write: Column | None = None) -> Column:
    """USD at 5 a million tokens in and 25 out; cached reads cost a tenth, cache writes five quarters of a token in."""
    read = cache_read if cache_read is not None else F.lit(0)
    write = cache_write if cache_write is not None else F.lit(0)
    return (tokens_in * 5.0 + tokens_out * 25.0 + read * 0.5 + write * 6.25) / 1e6


def preflight_usd(calls: Column, tokens_in: Column, tokens_out: Column, verifier: bool = True) -> Column:
    total = usd(calls * tokens_in, calls * tokens_out)
    if verifier:
        checks = F.greatest(F.lit(1), F.floor(calls / 2))
        total = total + usd(checks * tokens_in, checks * F.floor(tokens_out / 2))
    return total


def paywalled(c: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(m), F.lit(False)) for m in PAYWALLS))


def event_markdown(title: Column, author: Column, url: Column, at: Column, body: Column) -> Column:
    """A heading, the fields that are there as a list, and the body."""
    field = lambda name, c: F.when(nonempty(c).isNotNull(), F.concat(F.lit(f"- {name}: "), c))
    head = F.concat_ws("\n", F.concat(F.lit("# "), title), field("author", author), field("url", url), field("date", F.date_format(at, "yyyy-MM-dd HH:mm:ss")))
    return F.concat(head, F.lit("\n\n"), F.coalesce(body, F.lit("")))


def clip(c: Column, at: Column, before: int, after: int) -> Column:
    """The text around position `at` (from 1), with ellipses where it was cut."""
    start = F.greatest(F.lit(1), at - before)
    out = F.substring(c, start, at + after - start)
    return F.concat(F.when(start > 1, "...").otherwise(""), out, F.when(at + after - 1 < F.length(c), "...").otherwise(""))
