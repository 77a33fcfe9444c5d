"""Text and skill expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Skills with a spelling of their own.
CANONICAL_SKILLS = {"sql": "SQL", "python": "Python", "java": "Java", "javascript": "JavaScript", "aws": "AWS", "gcp": "GCP", "azure": "Azure", "c++": "C++", "c#": "C#", "r": "R"}
CARD_FIELDS = ("Title", "Experience", "Work type", "Location", "Skills", "Description")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Stripped, with single spaces."""
    return strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def non_empty(c: Column) -> Column:
    return strip(c) != ""


def job_card(title: Column, experience: Column, work_type: Column, location: Column, skills: Column, description: Column) -> Column:
    """One line for each field that is not blank, in a fixed order."""
    values = (title, experience, work_type, location, skills, description)
    return F.concat_ws("\n", *(F.when(strip(v) != "", F.concat(F.lit(f"{name}: "), strip(v))) for name, v in zip(CARD_FIELDS, values, strict=True)))


def _parts(c: Column, pattern: str | Column) -> Column:
    cleaned = F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), pattern), squeeze)
    return F.filter(cleaned, lambda x: x != "")


def split_growth(c: Column) -> Column:
    """For skill growth: on ``;`` if there is one, else on ``,``; lower case, repeats stay."""
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(low.contains(";"), _parts(low, ";")).otherwise(_parts(low, ","))


def split_cluster(c: Column) -> Column:
    """For cluster labels: on ``|``, ``,`` and ``;``; lower case, repeats stay."""
    return _parts(F.lower(c.cast("string")), r"[|,;]")


def normalize_skill(c: Column) -> Column:
    """Squeezed, without punctuation at the ends, in canonical spelling or with capitals."""
    low = F.lower(F.regexp_replace(squeeze(c), r"^[ .;:,|/\\]+|[ .;:,|/\\]+$", ""))
    table = F.create_map(*(F.lit(x) for kv in CANONICAL_SKILLS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, low), F.initcap(low))


def split_evolution(c: Column) -> Column:
    """For skill evolution: on ``;``, ``,`` and ``|``; normalised, repeats dropped in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), r"[;,|]"), normalize_skill), lambda x: x != ""))


def split_profile(c: Column) -> Column:
    """For profiles: on ``,`` only, case preserved."""
    return F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), ","), strip), lambda x: x != "")


def keyword_text(text: Column) -> Column:
    """What keywords are looked for in: lower case, squeezed, with ``/``, ``;`` and ``|`` as spaces."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[/;|]", " "))


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """Occurrences of the keywords as substrings; a keyword listed twice counts twice."""
    low = keyword_text(text)
    total = F.lit(0)
    for kw in keywords:
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(kw), F.lit("")))) / F.lit(len(kw))).cast("int")
    return total


def join_texts(columns: list[Column]) -> Column:
    """Joined by a space, empty ones too, then stripped."""
    return strip(F.concat(*(x for i, c in enumerate(columns) for x in ([F.lit(" ")] * (i > 0) + [F.coalesce(c.cast("string"), F.lit(""))]))))


def eval_text(title: Column, skills: Column | None, description: Column) -> Column:
    """Text of a job for retrieval evaluation: title, skills if not blank, description."""
    middle = [] if skills is None else [F.when(squeeze(skills) != "", F.concat(F.lit("SKILLS: "), squeeze(skills)))]
    return F.concat_ws("\n", F.concat(F.lit("TITLE: "), squeeze(title)), *middle, F.concat(F.lit("DESCRIPTION: "), squeeze(description)))


def tokens(text: Column, pattern: str = r"(?U)\b\w\w+\b") -> Column:
    """Lower-case words of two characters at least."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(pattern), F.lit(0))


def json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def strip_accents(text: Column) -> Column:
    """Compatibility-decomposed (NFKD) and without combining marks.

    Letters that become one are translated at once, marks dropped, and Latin
    ligatures, which become several, replaced where there are any. Beyond the
    basic plane, and syllables and symbols that decompose to several, stay.
    """
    import unicodedata

    def bare(c: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))

    plane = [chr(i) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000]
    pairs = [(c, d) for c in plane if len(d := bare(c)) == 1 and d != c]
    marks = [c for c in plane if unicodedata.combining(c)]
    ligatures = [(c, d) for c in plane if len(d := bare(c)) > 1 and (0x130 <= ord(c) < 0x250 or 0xFB00 <= ord(c) < 0xFB07)]
    out = F.translate(text, "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs))
    whole = out
    for c, d in ligatures:
        whole = F.replace(whole, F.lit(c), F.lit(d))
    return F.when(out.rlike("[" + "".join(c for c, _ in ligatures) + "]"), whole).otherwise(out)
