"""Quality checks of a question text: garbage, length, blacklists, confidence and verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import INSTRUCTIONS, MARKS_BARE, MARKS_BRACKETED

# Word lists and patterns of the checks.
ABBREVIATIONS = "cpu sram dram os fifo lru pcb mmu tlb i/o ram rom dma lan wan ip tcp udp sql xml dbms api acid oop uml dns http https ftp bjt fet op-amp alu asic fpga risc cisc cs".split()
SHORT_VERBS = ["define", "explain", "list", "state", "sketch"]
TWO_WORD_VERBS = [*SHORT_VERBS, "write"]
VERBS = "explain describe discuss compare differentiate analyze evaluate design calculate derive illustrate justify what why how when consider assume find determine show prove solve define write state list sketch verify identify trace compute formulate construct give elaborate distinguish summarize obtain".split()
METADATA = r"(?iU)\b(semester|branch|subject\s*code|school\s+of|kiit|university|examination|roll\s+no|reg\s+no|registration|sessional|mid-semester|end-semester|course|dept|department|programme|degree|tech|autumn|spring)\b"
PAGE = r"(?i)^\s*page\s+\d+|^\s*page\s+no|\bpg\s*\.?\s*\d+\b"
PLACEHOLDER = "[Subquestions Only]"
SYSTEM = r"(?i)^\s*\[subquestions\s+only\]\s*$"
FORMULA = r"(?i)^(consider|let|assume|for\b)"
PLAIN = r"""(?U)[\w\s+\-=*/()<>,.;?'"]"""
SHAPES = (r"\d+(\.\d+)?", r"[a-zA-Z\d]+['\-][a-zA-Z\d]+", r"[A-Z](\.[A-Z])+\.?", r"\(?[a-zA-Z\d\-]+\)?", r"\[[a-zA-Z\d\-]+\]", r"[a-zA-Z\d+\-=*/()<>,:!]+")


def words(text: Column) -> Column:
    """Runs between white space."""
    return F.array_remove(F.split(F.trim(text), r"(?U)\s+", -1), "")


def symbol_share(text: Column) -> Column:
    """Share of characters that are neither words, spaces nor usual marks; null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(text, PLAIN, "")), F.length(text))


def suspicious(token: Column) -> Column:
    """D2, for one token."""
    core = F.regexp_replace(token, r"(?U)^[^\w]+|[^\w]+$", "")
    low = F.lower(core)
    alphabetic = core.rlike(r"^\p{L}+$") & (F.length(core) >= 2)
    shouted = (core == F.upper(core)) & (core != low)
    no_vowel = alphabetic & ~shouted & ~low.rlike("[aeiouy]") & ~low.isin(ABBREVIATIONS)
    corrupt = core.rlike(r"[}{\]\[|\\^~_]")
    odd = ~core.rlike(r"^[\p{L}\p{N}]+$") & ~core.rlike("^(?:" + "|".join(SHAPES) + ")$")
    return (core != "") & (no_vowel | corrupt | odd)


def suspicious_share(tokens: Column) -> Column:
    """Share of suspicious tokens; null for none."""
    return F.try_divide(F.size(F.filter(tokens, suspicious)), F.size(tokens))


def blacklist(text: Column) -> Column:
    """Struct of confidence and reason of the first list that matches; null for none."""
    instruction = "(?iU)" + "|".join(rf"\b{p}\b" for p in INSTRUCTIONS)
    rows = ((METADATA, 5, "University metadata"), (instruction, 12, "Exam instruction"), (PAGE, 8, "Page metadata"), (SYSTEM, 0, "System-generated content"))
    out = None
    for pattern, confidence, reason in rows:
        value = F.struct(F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out


def _verb(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"(?U)[^\w]", ""))


def confidence(text: Column, tokens: Column) -> Column:
    """Points for cues of a question, 0 to 100."""
    verb = F.exists(F.slice(tokens, 1, 3), lambda w: _verb(w).isin(VERBS))
    asked = text.contains("?")
    marked = text.rlike(MARKS_BRACKETED) | text.rlike(MARKS_BARE)
    cased = F.upper(text) != F.lower(text)
    points = (
        F.lit(55)
        + F.when(verb, 25).otherwise(0)
        + F.when(asked, 25).otherwise(0)
        + F.when(marked, 15).otherwise(0)
        + F.when(F.length(text) > 20, 12).otherwise(0)
        - F.when(~verb & ~asked & ~marked & ~text.rlike(FORMULA), 25).otherwise(0)
        - F.when((text == F.upper(text)) & cased & (F.length(text) > 5), 20).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def verdict(points: Column) -> Column:
    """Struct of status and reason."""
    pair = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return (
        F.when(points < 40, pair("rejected", "Does not match question verbs/patterns"))
        .when(points <= 60, pair("review", "Borderline question indicators"))
        .otherwise(pair("accepted", "Genuine question indicators found"))
    )


def length_check(text: Column, tokens: Column) -> Column:
    """D3: confidence 15 for texts under ten characters, but for two words that begin with a verb; null if passed."""
    n = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    spared = (F.size(tokens) == 2) & _verb(F.get(tokens, F.lit(0))).isin(SHORT_VERBS)
    reason = F.concat(F.lit("Too short (length "), n.cast("string"), F.lit(" < 10 characters)"))
    return F.when((n < 10) & ~spared, F.struct(F.lit(15).alias("confidence"), reason.alias("reason")))


def word_check(tokens: Column) -> Column:
    """Single words, and two words without a verb; null if passed."""
    n = F.size(tokens)
    few = F.struct(F.lit(10).alias("confidence"), F.concat(F.lit("Too few words (count "), n.cast("string"), F.lit(" < 2)")).alias("reason"))
    two = F.struct(F.lit(20).alias("confidence"), F.lit("2-word block does not start with action verb").alias("reason"))
    return F.when(n < 2, few).when((n == 2) & ~_verb(F.get(tokens, F.lit(0))).isin(TWO_WORD_VERBS), two)


def garbage_check(text: Column, tokens: Column) -> Column:
    """D1 and D2 together: confidence 0 with its reason; null if passed."""
    share, broken = symbol_share(text), suspicious_share(tokens)
    zero = lambda r: F.struct(F.lit(0).alias("confidence"), F.concat(F.lit("OCR Garbage: "), r).alias("reason"))
    return (
        F.when(text == "", zero(F.lit("Empty text")))
        .when((share > 0.18) & (F.length(text) > 8), zero(F.lit("Too many special symbols")))
        .when((broken > 0.35) & (F.size(tokens) >= 2), zero(F.lit("Too many suspicious/broken words")))
    )


def validated(text: Column) -> Column:
    """Struct of confidence, status and reason; the checks in strict order."""
    t = F.trim(F.coalesce(text, F.lit("")))
    tokens = words(t)
    failed = F.coalesce(garbage_check(t, tokens), length_check(t, tokens), word_check(tokens), blacklist(t))
    points = confidence(t, tokens)
    return F.when(failed.isNotNull(), F.struct(failed["confidence"].alias("confidence"), F.lit("rejected").alias("status"), failed["reason"].alias("reason"))).otherwise(
        F.struct(points.alias("confidence"), verdict(points)["status"].alias("status"), verdict(points)["reason"].alias("reason"))
    )
