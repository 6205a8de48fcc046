"""Text cleaning, tokens and markers as Column expressions, in the common subset of Java and RE2 patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = "[^a-z0-9àâäáéèêëíîïñóôöúùûüçß]+"
#: Frequent words by language, enough to tell the languages of the corpus apart.
STOP_WORDS = {
    "en": "the of and to in is that for it was on are as with be this by from or at".split(),
    "fr": "le la les de des du un une et est que qui dans pour par sur au aux ce en".split(),
    "de": "der die das und ist von zu mit den im ein eine nicht für auf sich des dem als auch".split(),
    "es": "el los las del que y es una por con para como su al lo más se no un en".split(),
}
#: Page types by what a URL contains; the first that matches counts.
PAGE_TYPES = [("page=", "list"), ("/fr/", "french"), ("/de/", "german"), ("/es/", "spanish"), ("/en/", "english"), ("#", "section"), ("blog", "blog")]
#: Kinds of pages by what a URL contains; the first that matches counts.
PAGE_KINDS = {
    "homepage": "homepage",
    "home": "homepage",
    "about": "about",
    "about-us": "about",
    "alumni": "people",
    "alumni-interns": "people",
    "completed-projects": "research",
    "contact": "contacts",
    "contacts": "contacts",
    "current-projects": "research",
    "education": "teaching",
    "events": "activities",
    "facilities": "facilities",
    "former-members": "people",
    "funding": "funding",
    "group": "people",
    "lab-members": "people",
    "lectures": "teaching",
    "members": "people",
    "news": "news",
    "open-positions": "jobs",
    "openings": "jobs",
    "openpositions": "jobs",
    "our-research": "research",
    "outreach": "activities",
    "past-members": "people",
    "past-research": "research",
    "people": "people",
    "previousresearch": "research",
    "projects": "research",
    "publications": "publications",
    "research": "research",
    "research-projects": "research",
    "resources": "resources",
    "scientific-activities": "activities",
    "seminars": "activities",
    "student-projects": "student projects",
    "student_projects": "student projects",
    "studentprojects": "student projects",
    "teaching": "teaching",
    "teaching-projects": "teaching",
    "team": "people",
    "technical-reports": "publications",
}
ACCENTS = ("àâäáãåéèêëíîïìóôöòõúùûüçñÀÂÄÁÉÈÊËÍÎÏÓÔÖÚÙÛÜÇÑ", "aaaaaaeeeeiiiiooooouuuucnAAAAEEEEIIIOOOUUUUCN")


def words(text: Column) -> Column:
    """Lower-case words, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda w: F.length(w) > 0)


def plain_html(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, block tags become newlines, others spaces, entities characters."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(b|i|u|em|strong|span|a|sup|sub|small|font)( [^>]*)?>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def normalised(text: Column) -> Column:
    """Without URLs, addresses and tags, lower case, white space collapsed; the input where nothing is left."""
    t = F.regexp_replace(text, r"https?://[^ \n\t]+", " ")
    t = F.regexp_replace(t, r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[*+•|-][ \t]*", "")
    t = F.trim(F.regexp_replace(F.lower(t), r"[ \n\t\r]+", " "))
    return F.coalesce(F.nullif(t, F.lit("")), text)


def folded(text: Column, length: int = 16_384) -> Column:
    """Accents folded, quotes and slashes gone, white space collapsed, cut to a length."""
    t = F.translate(text, *ACCENTS)
    t = F.regexp_replace(t, "[\"'/\\\\]", "")
    return F.left(F.trim(F.regexp_replace(t, r"[ \n\t\r]+", " ")), F.lit(length))


def masked(text: Column) -> Column:
    """E-mail addresses, IP addresses, IBANs and telephone numbers replaced by their kind."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>")
    t = F.regexp_replace(t, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "<IP>")
    t = F.regexp_replace(t, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b", "<IBAN>")
    return F.regexp_replace(t, r"\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "<PHONE>")


def ngrams(tokens: Column, n: int) -> Column:
    """Sequences of n words, joined by spaces."""
    last = F.size(tokens) - n + 1
    many = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last >= 1, many).otherwise(F.array().cast("array<string>"))


def all_ngrams(tokens: Column) -> Column:
    """Sequences of words of every length, short ones first, in order."""
    n = F.size(tokens)
    of = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), of))).otherwise(F.array().cast("array<string>"))


def same_site_links(html: Column, url: Column) -> Column:
    """links() that stay on the site of the page: relative ones resolved against its root, in order."""
    root = F.regexp_extract(url, "^(https?://[^/?#]+)", 1)
    whole = F.transform(links(html), lambda u: F.when(F.startswith(u, F.lit("/")) & ~F.startswith(u, F.lit("//")), F.concat(root, u)).otherwise(u))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda u: host(u) == host(url))))


def chunks(tokens: Column, size: int = 400, overlap: int = 100) -> Column:
    """Windows of `size` words that start `size - overlap` apart and cover all of them."""
    step = size - overlap
    n = F.size(tokens)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda k: F.array_join(F.slice(tokens, (k * step + 1).cast("int"), size), " "))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://(?:www\.)?([^/?#]+)", 1)


def base_token(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://(www\.)?", "")


def sublink_token(base: Column, url: Column) -> Column:
    return F.concat(base, F.lit("___"), F.left(F.md5(url), F.lit(8)))


def page_type(url: Column) -> Column:
    kind = F.lit("other")
    for mark, name in reversed(PAGE_TYPES):
        kind = F.when(F.contains(url, F.lit(mark)), name).otherwise(kind)
    return kind


def links(html: Column) -> Column:
    """Distinct link targets in order, without trailing slash."""
    found = F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))
    kept = F.filter(found, lambda u: ~F.lower(u).rlike(r"\.(pdf|png|jpg|mp3|mp4)$") & ~u.contains("wp-admin"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda u: F.regexp_replace(u, "/$", ""))))


def language(tokens: Column) -> Column:
    """The language with the most frequent words among the tokens; the first by name among equals, null without any."""
    frequent = lambda known: F.size(F.filter(tokens, lambda w: w.isin(known)))
    votes = {k: frequent(v) for k, v in sorted(STOP_WORDS.items())}
    top = F.greatest(*votes.values())
    best = F.lit(None).cast("string")
    for k in reversed(votes):
        best = F.when(votes[k] == top, k).otherwise(best)
    return F.when(top > 0, best)


def page_kind(url: Column, base: Column) -> Column:
    """What kind of page an address tells of: the homepage if it is the base, null if nothing in it tells."""
    kind = F.lit(None).cast("string")
    for mark, name in reversed(PAGE_KINDS.items()):
        kind = F.when(F.contains(url, F.lit(mark)), name).otherwise(kind)
    return F.when(url == base, "homepage").otherwise(kind)


def main_part(html: Column) -> Column:
    """What the first main element holds, or else the body, or else all."""
    part = lambda tag, rest: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>({rest})</{tag}>", 1), F.lit(""))
    return F.coalesce(part("main", ".*?"), part("body", ".*"), html)
