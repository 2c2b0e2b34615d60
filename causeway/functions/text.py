"""Text expressions: ``Column -> Column``, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from causeway import fixed_values as fv

_EDGE_SPACE = rf"(?U)^{fv.SPACE}+|{fv.SPACE}+$"
_ODD_SPACE = rf"(?U)[{fv.SPACE}&&[^ ]]|  "  # white space that is not one plain space
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_WORD_MARK = "\u0001 "


def tokens(text: Column) -> Column:
    """Words separated by Unicode white space, no empty words."""
    return F.array_remove(F.split(text, rf"(?U){fv.SPACE}+"), "")


def has_words(text: Column) -> Column:
    """Whether there is more than white space; of most texts only the start is read."""
    return F.substring(text, 1, 64).rlike(rf"(?U)[^{fv.SPACE}]") | F.rlike(text, F.lit(rf"(?U)[^{fv.SPACE}]"))


def spaced(text: Column) -> Column:
    """The words of ``tokens`` with one space between them, without an array of them."""
    odd = F.rlike(text, F.lit(_ODD_SPACE))
    return F.trim(F.when(odd, F.regexp_replace(text, rf"(?U){fv.SPACE}+", " ")).otherwise(text))


def spaced_words(said: Column) -> Column:
    """Number of words in a text with one space between them."""
    spaces = F.octet_length(said) - F.octet_length(F.replace(said, F.lit(" "), F.lit("")))
    return F.when(said == "", 0).otherwise(spaces + 1).cast("bigint")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def title_case(text: Column) -> Column:
    """Upper-case each letter that follows a non-letter (``5xx`` becomes ``5Xx``).

    ``initcap`` starts a word only after a space, so a marked space is put before
    every other word start and taken out again.
    """
    marked = F.regexp_replace(F.lower(text), rf"(?<=[^{_CASED} ])(?=[{_CASED}])", _WORD_MARK)
    return F.replace(F.initcap(marked), F.lit(_WORD_MARK), F.lit(""))


def _first_match(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def line_timestamp(line: Column, syslog_first: bool = False) -> Column:
    """Time of a log line: the patterns are tried in order, position is irrelevant."""
    patterns = fv.LINE_TIMESTAMPS
    if syslog_first:
        patterns = [patterns[0], patterns[2], patterns[1]]
    return F.coalesce(*[_first_match(line, p) for p in patterns])


def log_level(line: Column) -> Column:
    return F.upper(_first_match(line, fv.LOG_LEVEL, 1))


def event_timestamp(text: Column) -> Column:
    """Leftmost time in a chunk, kept as text."""
    return _first_match(text, fv.EVENT_TIMESTAMP)


def document_type(filename: Column) -> Column:
    """Document type from the file name; the first rule that applies wins."""
    name = F.lower(filename)
    return (
        F.when(name.endswith(".log"), "LOG")
        .when(name.endswith(".pdf"), "PDF")
        .when(name.contains("runbook"), "RUNBOOK")
        .when(name.contains("incident") | name.contains("postmortem"), "INCIDENT_REPORT")
        .when(name.contains("arch") | name.contains("design"), "ARCHITECTURE_DOC")
        .otherwise("TEXT")
    )


def one_line(text: Column) -> Column:
    return F.replace(strip(text), F.lit("\n"), F.lit(" "))


def shorten(text: Column, length: int) -> Column:
    """The first ``length`` characters, with an ellipsis if something was cut."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def summary(text: Column) -> Column:
    """Summary of a chunk when no model is configured."""
    return shorten(one_line(text), 180)


def snippet(text: Column) -> Column:
    return F.substring(one_line(text), 1, 140)


def event_title(snip: Column) -> Column:
    return shorten(snip, 60)


def severity(snip: Column) -> Column:
    """``warning`` if the snippet, not the whole chunk, has a trouble word."""
    return F.when(F.lower(snip).rlike("|".join(fv.SEVERITY_WORDS)), "warning").otherwise("info")


def question_keywords(question: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of a question, without stop words and words under 3 letters."""
    stop = F.array(*[F.lit(w) for w in (fv.STOP_WORDS if stop_words is None else stop_words)])
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[a-z0-9\-]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def default_question(question: Column) -> Column:
    return F.coalesce(F.nullif(question, F.lit("")), F.lit(fv.DEFAULT_QUESTION))


def query_text(question: Column, prefix: str = "Find incident passages that answer: ") -> Column:
    """Question with the retrieval instruction that embedding models expect."""
    return F.concat(F.lit(prefix), question)


def default_title(title: Column, investigation_id: Column) -> Column:
    return F.coalesce(
        F.nullif(title, F.lit("")),
        F.concat(F.lit("Investigation "), F.substring(investigation_id, 1, 8)),
    )


def event_time_label(timestamp: Column, order: Column) -> Column:
    """Time to show for an event: its text, else its position counted from 1."""
    return F.coalesce(
        F.nullif(timestamp, F.lit("")), F.concat(F.lit("#"), (order + 1).cast("string"))
    )
