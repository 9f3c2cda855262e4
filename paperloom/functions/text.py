"""Text scalars as column expressions: line filters, repairs, normal forms, marks and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Banner texts that mark a line as noise; callers may pass their own.
BANNERS = ("nitr", "national institute of technology rourkela", "best of luck", "all the best", "time allowed", "max marks", "watermark", "confidential")
ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx")

# Starts of noise lines, and the prefixes that a wording loses before it is compared.
NOISE_STARTS = r"page\s*[-:\s]*\d+(\s*(of|/)\s*\d+)?\s*$|pg\.?\s*\d+\s*$|registration\s*no|roll\s*no|sem(ester)?\s*exam"

PREFIXES = (r"^\s*(?:q|question)\s*\d+[\s.:,\-]*", r"^\s*\d+[.:\-]+\s*", r"^\s*(?:\([a-z0-9]+\)|[a-z0-9]+[).:\-])\s*")

# Exam instructions, also used by the validator.
INSTRUCTIONS = (
    r"answer\s+all\s+(the\s+)?questions",
    r"answer\s+any\s+(four|three|five|two|one|six)\s+questions",
    r"attempt\s+any",
    r"attempt\s+all",
    r"full\s+marks",
    r"time\s*:",
    r"best\s+of\s+luck",
    r"all\s+the\s+best",
    r"figures\s+in\s+the\s+margin",
    r"candidates\s+are\s+required",
    r"maximum\s+marks",
    r"questions\s+carry\s+equal\s+marks",
    r"write\s+answers\s+in\s+your\s+own",
)
GENERIC_INSTRUCTIONS = (
    r"\b(answer|attempt)\s+(all|any|the\s+following|questions)\b",
    r"^\s*(answer|attempt|choose|select)\s+(the\s+following|any|all|questions|one|two|three|four|five)\b",
    r"^\s*(answer|attempt)\s*$",
)

# Marks, in the order in which they are tried.
MARKS_PRODUCT = r"(?i)([(\[]\s*(\d+)\s*(?:marks?|m|mark\s+each)?\s*[x*]\s*(\d+)\s*(?:marks?|m)?\s*[)\]])"
MARKS_BRACKETED = r"(?i)([(\[]\s*(\d+)\s*(?:marks?|m)?\s*[)\]])"
MARKS_BARE = r"(?i)\b(\d+)\s*(?:marks?|m)\b"


def at_start(text: Column | str, pattern: str, group: int = 0) -> Column:
    """What a pattern that begins with ^ takes of a text, or one of its groups; empty if nothing. An empty match at the start ends the search there, where it would go on through the text."""
    return F.regexp_extract(text, f"{pattern}|^", group)


def is_noise_line(line: Column, banners: tuple[str, ...] = BANNERS) -> Column:
    """B1: footers, banners, roll numbers and the like."""
    line = F.trim(line)
    noise = at_start(line, rf"(?i)^\s*({NOISE_STARTS})") != ""
    if not banners:
        return noise
    anywhere = line.rlike("(?i)" + "|".join(r"\s+".join(b.split()) for b in banners))
    firsts = {b.split()[0].lower() for b in banners if b.strip()}
    if len(firsts) == len({b.split()[0] for b in banners if b.strip()}) and all(b.strip() for b in banners) and all(w.isascii() and w.isalnum() for w in firsts):
        # a line without the first word of any banner has none of them
        worded = F.lit(False)
        for word in sorted(firsts):
            worded = worded | F.lower(line).contains(word)
        anywhere = worded & anywhere
    return noise | anywhere


# Repairs in the order in which they apply.
REPAIRS = (
    (r"^\s*(\d{1,3})[,:](?=\s|$)", "$1."),
    (r"(?i)^\s*([ivx]+)[,:](?=\s|$)", "$1."),
    (r"(?i)^\s*(Q\d{1,3}):(?=\s|$)", "$1."),
    (r"\b(Question|Q)\s*[lL|]\b", "$1 1"),
    (r"(?i)\b([1-9])o\s*(?:marks?|m)\b", r"$1\0 marks"),
    (r"([(\[]\s*\d*)[Oo](\d*\s*[)\]])", r"$1\0$2"),
    (r"^\s*l([.):,])", "1$1"),
    (r"^\s*(\d+)(?:st|nd|rd|th|[sS])(?=\s|$)", "$1."),
    (r"^\s*([ivxIVX]+)[sS](?=\s|$)", "$1."),
)


# What a line has that any of the repairs can match: at its start, or anywhere.
REPAIRED_START, REPAIRED = r"^\s*(?:[0-9ivxIVX]+[,:sS]|\d+(?:st|nd|rd|th)|[qQ]\d+:|l[.):,])", r"[Qn]\s*[lL|]|[1-9][oO]|[(\[]\s*\d*[Oo]"


def repaired_line(line: Column) -> Column:
    """B2: numbering and marks that scanning has garbled. Most lines need no repair, which two patterns tell; the others go through all repairs."""
    repaired = line
    for pattern, to in REPAIRS:
        repaired = F.regexp_replace(repaired, pattern, to)
    return F.when((at_start(line, REPAIRED_START) != "") | line.rlike(REPAIRED), repaired).otherwise(line)


def cleaned_question(text: Column) -> Column:
    """One line, without stray marks, repeated punctuation or double spaces; null is empty."""
    given = text = F.translate(F.coalesce(text, F.lit("")), "\n\r", "  ")
    text = F.regexp_replace(text, r"\s+[\\|_~^]\s+", " ")
    text = F.regexp_replace(text, r"^[\\|_~^]\s+|\s+[\\|_~^]$", " ")
    for mark, least in ((".", 3), ("?", 2), ("!", 2), ("-", 3)):
        text = F.regexp_replace(text, rf"[{mark}]{{{least},}}", mark)
    text = F.regexp_replace(text, r"\s+", " ")
    # without stray marks, repeats and white space other than single spaces there is nothing to clean
    return F.trim(F.when(given.rlike(r"[\\|_~^\t\x0B\f]|([.?!\- ])\1"), text).otherwise(given))


def normal_number(number: Column) -> Column:
    """Without dots, colons, dashes and spaces at the ends."""
    return F.regexp_replace(F.coalesce(number, F.lit("")), r"^[.:;\-\s]+|[.:;\-\s]+$", "")


def normal_text(text: Column) -> Column:
    """The form in which wordings are compared. Words of a to z with a space between them, and points at the end only, lose the points and nothing else."""
    low = text = F.lower(F.coalesce(text, F.lit("")))
    for prefix in PREFIXES:
        text = F.regexp_replace(text, prefix, "")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.trim(F.regexp_replace(text, r"(?U)[^\w\s()]", ""))
    body = F.rtrim(low, F.lit("."))
    plain = body.contains(" ") & ~body.rlike("[^a-z ]") & ~body.contains("  ") & ~body.startswith(" ") & ~body.endswith(" ")
    return F.when(plain, body).otherwise(text)


def text_hash(normal: Column) -> Column:
    """B6"""
    return F.sha2(normal, 256)


def marks(text: Column) -> Column:
    """Struct of value (a product's value is its two factors'), a, b (the factors), pattern, and the text without any occurrence of the pattern."""
    product, bracketed, bare = F.regexp_extract(text, MARKS_PRODUCT, 1), F.regexp_extract(text, MARKS_BRACKETED, 1), F.regexp_extract(text, MARKS_BARE, 0)
    a, b = (F.regexp_extract(text, MARKS_PRODUCT, i).cast("int") for i in (2, 3))
    pattern = F.when(product != "", product).when(bracketed != "", bracketed).when(bare != "", bare)
    value = F.when(product != "", (a * b).cast("double")).when(bracketed != "", F.regexp_extract(text, MARKS_BRACKETED, 2).cast("double")).when(bare != "", F.regexp_extract(text, MARKS_BARE, 1).cast("double"))
    rest = F.when(pattern.isNull(), text).otherwise(F.replace(text, pattern, F.lit("")))
    return F.struct(value.alias("value"), F.when(product != "", a).alias("a"), F.when(product != "", b).alias("b"), pattern.alias("pattern"), rest.alias("rest"))


def with_marks(rows: DataFrame, text: str, name: str) -> DataFrame:
    """B7 as a column of rows: what marks gives, by steps that are columns of their own, so each pattern is sought once, and only where those before it aren't found."""
    steps = [f"_{name}_{k}" for k in range(3)]
    # no pattern is without a digit
    rows = rows.withColumn(steps[0], F.when(F.col(text).rlike(r"[0-9]"), F.regexp_extract(text, MARKS_PRODUCT, 1)))
    for before, now, pattern, group in ((steps[0], steps[1], MARKS_BRACKETED, 1), (steps[1], steps[2], MARKS_BARE, 0)):
        rows = rows.withColumn(now, F.when(F.col(before) == "", F.regexp_extract(text, pattern, group)).otherwise(F.col(before)))
    # a pattern found reads by itself as it does in its text
    found = F.nullif(F.col(steps[2]), F.lit(""))
    own = marks(found)
    rest = F.when(found.isNull(), F.col(text)).otherwise(F.replace(F.col(text), found, F.lit("")))
    return rows.withColumn(name, F.struct(own["value"].alias("value"), own["a"].alias("a"), own["b"].alias("b"), found.alias("pattern"), rest.alias("rest"))).drop(*steps)


#: Each instruction, generic ones included, has one of these words; texts without any aren't matched with the patterns.
INSTRUCTION_WORDS = ("answer", "attempt", "full", "time", "best", "figures", "candidates", "maximum", "questions", "choose", "select")


def is_instruction(text: Column) -> Column:
    """Generic "answer/attempt any ..." texts, and blank ones."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    bounded = "|".join(rf"\b{p}\b" for p in INSTRUCTIONS)
    worded = F.lit(False)
    for word in INSTRUCTION_WORDS:
        worded = worded | low.contains(word)
    return (low == "") | (worded & low.rlike("(?U)" + bounded + "|" + "|".join(GENERIC_INSTRUCTIONS)))


def marker(label: Column) -> Column:
    """Struct of type and value; both null for anything else. i, v and x overlap between letters and romans."""
    s = F.trim(label)
    low = F.lower(s)
    roman = F.array_position(F.array(*[F.lit(r) for r in ROMANS]), low).cast("int")
    case = F.when(s == low, "lower").when(s == F.upper(s), "upper")
    letter = (F.ascii(low) - 96).cast("int")
    kind = (
        F.when(s.rlike(r"^\d+$"), "num")
        .when(low.isin("i", "v", "x"), F.concat(F.lit("overlap_"), case))
        .when((roman > 0) & case.isNotNull(), F.concat(F.lit("roman_"), case))
        .when(s.rlike("^[a-zA-Z]$"), F.concat(F.lit("alpha_"), case))
    )
    value = F.when(kind == "num", s.try_cast("int")).when(kind.startswith("alpha"), letter).when(kind.isNotNull(), roman)
    return F.struct(kind.alias("type"), value.alias("value"))


def label_of(kind: Column, n: Column) -> Column:
    """The label at a place in a sequence; ? beyond its end."""
    letter, roman = F.char(96 + n), F.get(F.array(*[F.lit(r) for r in ROMANS]), (n - 1).cast("int"))
    found = (
        F.when(kind == "num", n.cast("string"))
        .when((kind == "alpha_lower") & n.between(1, 26), letter)
        .when((kind == "alpha_upper") & n.between(1, 26), F.upper(letter))
        .when((kind == "roman_lower") & (n >= 1), roman)
        .when((kind == "roman_upper") & (n >= 1), F.upper(roman))
    )
    return F.coalesce(found, F.lit("?"))


def trimmed_end(text: Column) -> Column:
    """No dots, colons, commas or dashes at the end, no spaces at the ends."""
    return F.trim(F.regexp_replace(F.trim(text), r"[.:,\-]+$", ""))
