"""Text functions as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search passes over.
STOP_WORDS = (
    "a an and are as at be by can did do does for from had has have how i in is it me my of on or our please tell that the "
    "their them there these they this to us was we were what when which who why will with would you your"
).split()


def text(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: str | Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text(x), F.lit(""))


def safe_filename(name: str | Column) -> Column:
    """A name that can stand as a file's: no reserved character, no border dots, single spaces, never empty."""
    clean = F.trim(F.regexp_replace(text(name), r'[\\/:*?"<>|#^\[\]]', "-"))
    clean = F.regexp_replace(F.regexp_replace(clean, r"^\.+|\.+$", ""), r"\s+", " ")
    return F.coalesce(blank_to_null(clean), F.lit("Untitled"))


def format_timestamp(seconds: str | Column) -> Column:
    """HH:MM:SS of seconds, rounded half to even, never below zero."""
    s = F.greatest(F.bround(text(seconds).cast("double"), 0).cast("long"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def format_duration(seconds: str | Column) -> Column:
    """12s, 34m or 1h05m."""
    x = text(seconds).cast("double")
    minutes = F.bround(x / 60, 0).cast("long")
    return (
        F.when(x < 60, F.format_string("%ds", F.bround(x, 0).cast("long")))
        .when(minutes < 60, F.format_string("%dm", minutes))
        .otherwise(F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60))
    )


def fix_spacing(joined: Column) -> Column:
    """No white space before closing punctuation nor after an opening bracket."""
    return F.regexp_replace(F.regexp_replace(joined, r"\s+([,.;:!?%)\]}])", "$1"), r"([(\[{])\s+", "$1")


def join_words(words: str | Column) -> Column:
    """The words of an array as running text; blank ones are left out."""
    trimmed = F.filter(F.transform(text(words), lambda w: F.trim(w)), lambda w: w != "")
    return fix_spacing(F.array_join(trimmed, " "))


def terms(x: str | Column) -> Column:
    """Search terms: letters and digits in lower case without stop words, plural s cut off."""
    words = F.regexp_extract_all(F.lower(text(x)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1))
    return F.transform(kept, lambda w: F.when(w.endswith("s") & (F.length(w) > 4), F.left(w, F.length(w) - 1)).otherwise(w))


def spoken_words(x: str | Column) -> Column:
    """Words for error rates: lower case, straight apostrophes, no other punctuation."""
    plain = F.regexp_replace(F.replace(F.lower(text(x)), F.lit("’"), F.lit("'")), r"[^\p{L}\p{N}_\s']", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def estimate_tokens(x: str | Column) -> Column:
    return F.floor(F.length(text(x)) / 4) + 1


def transcript_line(turn: Column, start: Column, name: Column, said: Column) -> Column:
    return F.concat(F.lit("["), turn, F.lit(" "), format_timestamp(start), F.lit("] "), name, F.lit(": "), said)


def slug(x: str | Column, mark: str, longest: int, default: str = "") -> Column:
    """Lower case with runs of other characters as one mark, at most ``longest`` characters."""
    body = F.regexp_replace(F.lower(text(x)), "[^a-z0-9]+", mark)
    return F.coalesce(blank_to_null(F.left(F.regexp_replace(body, f"^{mark}+|{mark}+$", ""), F.lit(longest))), F.lit(default))


def tag(x: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text(x)), r"[^\p{L}\p{N}_-]+", "-"))


def section(body: str | Column, heading: str) -> Column:
    """What stands under a second-level heading, without placeholder lines ``_like this_``."""
    begun = F.regexp_extract(text(body), rf"(?ims)^##\s+\Q{heading}\E[ \t]*$(.*)", 1)
    rest = F.regexp_replace(begun, r"(?ms)^#{1,2}\s.*\z", "")
    lines = F.filter(F.split(F.trim(rest), r"\r?\n"), lambda x: ~F.trim(x).rlike("^_.*_$"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def front_matter(x: str | Column) -> Column:
    """(header, body) of a note: the YAML between ``---`` fences and the text behind them."""
    t = text(x)
    end = F.when(t.startswith("---\n"), F.locate("\n---", t, 5)).otherwise(0)
    return F.struct(
        F.when(end > 0, F.substr(t, F.lit(5), end - 5)).otherwise(F.lit("")).alias("header"),
        F.when(end > 0, F.regexp_replace(F.substr(t, end + 4), r"^\n+", "")).otherwise(t).alias("body"),
    )


def escape_label(x: str | Column) -> Column:
    """A Markdown link's label with its special characters escaped."""
    return F.regexp_replace(text(x), r"([\\\[\]])", r"\\$1")


def percent_path(x: str | Column) -> Column:
    """A relative path, percent-encoded, with slashes kept and spaces as %20."""
    return F.replace(F.replace(F.url_encode(text(x)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def initials(name: str | Column) -> Column:
    """The first letters of the first and the last word, in capitals."""
    words = F.filter(F.split(text(name), r"\s+"), lambda w: w != "")
    first, last = F.left(F.get(words, F.lit(0)), F.lit(1)), F.left(F.element_at(words, -1), F.lit(1))
    return F.when(F.size(words) == 0, F.lit("?")).when(F.size(words) == 1, F.upper(first)).otherwise(F.upper(F.concat(first, last)))


def day_of(date: str | Column) -> Column:
    """The local day of an ISO date or timestamp text; null where there is none."""
    return F.left(text(date), F.lit(10)).try_cast("date")


def ends_sentence(x: str | Column) -> Column:
    return F.rtrim(text(x)).rlike(r"[.?!]$")


def clean_name(x: str | Column) -> Column:
    """A speaker's name with single spaces; null if it is empty, too long or has characters of note links."""
    name = F.trim(F.regexp_replace(text(x), r"\s+", " "))
    return F.when((name != "") & (F.length(name) <= 120) & ~name.rlike(r"[\[\]|^#]"), name)


def people_line(names: str | Column, longest: int) -> Column:
    """Names joined by commas, cut to ``longest`` characters."""
    return F.left(F.array_join(text(names), ", "), F.lit(longest))


def cite_number_cleanup(answer: str | Column, valid: str | Column) -> Column:
    """The text without citations ``[n]`` whose number isn't among the valid ones."""
    t = text(answer)
    wrong = F.array_except(F.transform(F.regexp_extract_all(t, F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int")), text(valid))
    return F.aggregate(wrong, t, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(r"\[0*"), n.cast("string"), F.lit(r"\]")), F.lit("")))


def cited_numbers(answer: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text(answer), F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int"))))


def json_text(x: str | Column) -> Column:
    """A JSON string literal, or null."""
    inner = F.to_json(F.array(text(x)))
    return F.when(text(x).isNull(), F.lit("null")).otherwise(F.substr(inner, F.lit(2), F.length(inner) - 2))


def due_mark(due: str | Column) -> Column:
    """How a due date stands in a task's line: an ISO date behind a calendar sign, anything else in brackets."""
    d = text(due)
    return F.when(d.isNull() | (d == ""), F.lit("")).when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.lit(" 📅 "), d)).otherwise(F.concat(F.lit(" (due: "), d, F.lit(")")))
