"""Names, tokens, dates and small encodings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols that cleaning turns to spaces, characters that an index name may not hold, and kinds of files.
PUNCTUATION = ".,;:!?()[]"
INVALID = '\\/*?"<>| ,;:#'
KINDS = {"pdf": "document", "html": "page", "php": "page", "png": "image", "jpg": "image", "jpeg": "image", "mp3": "audio", "wav": "audio", "mp4": "video", "mkv": "video"}


def without_punctuation(text: Column) -> Column:
    """Ten symbols become spaces, and runs of white space one space."""
    return F.trim(F.regexp_replace(F.translate(text, PUNCTUATION, " " * len(PUNCTUATION)), r"[ \n\t\r]+", " "))


def equal_letters(a: Column, b: Column) -> Column:
    """Whether the letters at each place are equal; null if the lengths differ."""
    letters = lambda c: F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))
    return F.when(F.length(a) == F.length(b), F.zip_with(letters(a), letters(b), lambda x, y: x == y))


def shifted(text: Column, by: Column) -> Column:
    """The text turned to the right by a number of letters, its end in front; an empty text stays empty."""
    k = F.when(F.length(text) > 0, F.pmod(by, F.length(text))).otherwise(0)
    return F.concat(F.right(text, k), F.substring(text, F.lit(1), F.length(text) - k))


def places_of_spaces(text: Column) -> Column:
    """From 0, in order."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.transform(F.filter(at, lambda k: F.substring(text, k, F.lit(1)) == " "), lambda k: k - 1)


def listed(words: Column) -> Column:
    """'a, b and c'; one word is itself, none is empty."""
    n = F.size(words)
    many = F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(words, -1))
    return F.when(n == 0, "").when(n == 1, F.get(words, F.lit(0))).otherwise(many)


def described(*parts: Column) -> Column:
    """The parts joined by spaces; a null one counts as empty and keeps its space."""
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def text_token(text: Column, *suffixes: Column) -> Column:
    """The md5 of a text and what it was made for, such as languages or a model."""
    return F.concat_ws("_", F.md5(text), *suffixes)


def origin_token(origin: Column, info: Column) -> Column:
    """Where something comes from, with what identifies it there."""
    return F.concat(F.lower(origin), F.lit(":"), info)


def extension(name: Column) -> Column:
    """What follows the last dot of a name without query or fragment, in lower case; empty if nothing does."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, "[?#].*$", ""), r"\.([A-Za-z0-9]{1,5})$", 1))


def kind_of_file(name: Column) -> Column:
    out = F.lit("other")
    for ext, kind in KINDS.items():
        out = F.when(extension(name) == ext, kind).otherwise(out)
    return out


def is_url(text: Column) -> Column:
    return F.startswith(text, F.lit("http://")) | F.startswith(text, F.lit("https://"))


def is_token(text: Column) -> Column:
    """Whether a text is a token of ours: 32 hex digits, perhaps with suffixes."""
    return text.rlike("^[0-9a-f]{32}(_.+)?$")


def index_name(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("-"), F.lit(""))


def has_invalid_characters(name: Column) -> Column:
    """Whether an index name has a character that indexes refuse; the normalised name is what counts."""
    return F.translate(name, INVALID, "") != name


def sentences(text: Column) -> Column:
    """The sentences of a text, line breaks ending one too; a text of under four letters is one, as it is."""
    parts = F.split(F.regexp_replace(text, r"[ ]*[\n\r]+", ". "), r"[.!?]+[ ]+")
    parts = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    return F.when(F.length(text) < 4, F.array(text)).otherwise(parts)


def without_fences(text: Column) -> Column:
    """JSON as a chat answer wraps it, without its Markdown fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^[ \n]*```(json)?[ ]*\n", ""), r"\n[ ]*```[ \n]*$", ""))


def add_years(day: Column, n: int) -> Column:
    """The same day n years on; 29 February becomes 28 in other years."""
    return F.add_months(day, 12 * n)


def duration_seconds(log: Column) -> Column:
    """The last HH:MM:SS.cc in a log, in seconds; null without any."""
    found = F.regexp_extract_all(log, F.lit(r"(\d+:\d\d:\d\d\.\d\d)"), F.lit(1))
    last = F.split(F.when(F.size(found) > 0, F.element_at(found, -1)), ":")
    return last[0].cast("double") * 3600 + last[1].cast("double") * 60 + last[2].cast("double")


def vector_json(vector: Column) -> Column:
    """A vector as JSON, rounded to nine decimals."""
    return F.to_json(F.transform(vector, lambda x: F.round(x.cast("double"), 9)))


def vector_of_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def inverted(map_: Column) -> Column:
    """Values to keys; values have to differ."""
    return F.map_from_entries(F.transform(F.map_entries(map_), lambda e: F.struct(e["value"], e["key"])))


def masked_score(score: Column, manual: Column, least: float = 0.1) -> Column:
    """A detected score under `least` is zero unless there is a manual one."""
    return F.when((score < least) & (F.coalesce(manual, F.lit(0.0)) == 0), 0.0).otherwise(score)


def valid_at(now: Column, since: Column, until: Column) -> Column:
    """Whether a moment lies in a validity interval, ends included; a null end is open."""
    return F.coalesce(since <= now, F.lit(True)) & F.coalesce(until >= now, F.lit(True))


def difference_hash(pixels: Column, width: int) -> Column:
    """Bits of an image, row by row: whether a pixel is brighter than its left neighbour."""
    at = F.filter(F.sequence(F.lit(1), F.size(pixels) - 1), lambda k: k % width != 0)
    return F.transform(at, lambda k: (F.get(pixels, k) > F.get(pixels, k - 1)).cast("int"))


def common_letters(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two short texts, one fold inside another: no Python."""
    y = F.transform(F.sequence(F.lit(1), F.length(b)), lambda k: F.substring(b, k, F.lit(1)))
    none = F.array().cast("array<int>")

    def row(before: Column, c: Column) -> Column:
        def cell(state: Column, k: Column) -> Column:
            left = F.when(F.size(state) > 0, F.element_at(state, -1)).otherwise(0)
            up, corner = F.get(before, k), F.when(k > 0, F.get(before, k - 1)).otherwise(0)
            return F.concat(state, F.array(F.when(F.get(y, k) == c, corner + 1).otherwise(F.greatest(left, up)).cast("int")))

        return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), none, cell)

    start = F.transform(F.sequence(F.lit(1), F.length(b)), lambda k: F.lit(0))
    x = F.transform(F.sequence(F.lit(1), F.length(a)), lambda k: F.substring(a, k, F.lit(1)))
    found = F.element_at(F.aggregate(x, start, row), -1)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), found).otherwise(0)
