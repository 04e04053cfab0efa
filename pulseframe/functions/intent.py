"""Rule-based intent labels, taxonomy and sentiment label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.functions.text import casefold

# --- fixed values: taxonomy -------------------------------------------------
GENERAL = "general_discussion"
ACTIONABLE_CLASSES = (
    "high_intent",
    "nostalgia_reactivation",
    "new_customer_interest",
    "frustrated_demand",
    "content_drought_fatigue",
    "confusion_barrier",
    "expectation_decay",
)
TAXONOMY = (*ACTIONABLE_CLASSES, GENERAL)
RULE_HIT_CONFIDENCE = 0.7
RULE_MISS_CONFIDENCE = 0.3
POSITIVE_FROM = 0.05
NEGATIVE_FROM = -0.05

# --- fixed values: ordered rules, first matching label wins --------------------
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("expectation_decay", (
        r"\bdon'?t care anymore\b",
        r"\blost interest\b",
        r"\bi(?: have|'ve) moved on\b",
        r"\bstopped caring\b",
        r"\bnot buying (?:it|this)\b",
        r"\bi(?: am|'m) not buying\b",
        r"\bno faith\b",
        r"\bno trust\b",
        r"\bdoesn'?t exist to me\b",
    )),
    ("high_intent", (
        r"\bbuy(?:ing)?\b",
        r"\bbought\b",
        r"\bpre[ -]?order\b",
        r"\bday one\b",
        r"\breplay(?:ing)?\b",
        r"\bplay again\b",
        r"\b100%\b",
        r"\bachievements?\b",
        r"\bcomplete (?:the )?series\b",
        r"\bi(?: am|'m) going to play\b",
        r"\bi(?: wi)?ll play\b",
        r"\bi(?: am|'m) getting (?:it|this)\b",
        r"\bi(?: have|'ve) bought (?:this|the) series\b",
    )),
    ("new_customer_interest", (
        r"\bnever played\b",
        r"\bfirst time playing\b",
        r"\bfinally (?:able|get) to play\b",
        r"\bnow (?:that|its|it is) on (?:steam|pc|switch)\b",
        r"\b(?:can|could) finally play\b",
        r"\bthinking about starting\b",
        r"\bentry point\b",
        r"\baccessible\b",
        r"\blocali[sz]ation\b",
    )),
    ("confusion_barrier", (
        r"\bconfusing\b",
        r"\bconvoluted\b",
        r"\bhard to follow\b",
        r"\bdon'?t understand\b",
        r"\bwhat order do i play\b",
        r"\bwhich games are required\b",
        r"\bmakes no sense\b",
        r"\btoo much information\b",
        r"\boverwhelmed\b",
        r"\b(?:i'?m|im) lost\b",
    )),
    ("content_drought_fatigue", (
        r"\bcopium\b",
        r"\bstarving\b",
        r"\bdrought\b",
        r"\bcrumbs\b",
        r"\bclown makeup\b",
        r"\b(?:we'?ll|i'?ll) take anything\b",
        r"\bat this point (?:we'?ll|i'?ll) take anything\b",
    )),
    ("frustrated_demand", (
        r"\bstill waiting\b",
        r"\bno (?:news|trailer|updates?)\b",
        r"\brelease date\b",
        r"\byears? of silence\b",
        r"\bgive us something\b",
        r"\bcontent drought\b",
        r"\b\d+ years?\b",
    )),
    ("nostalgia_reactivation", (
        r"\bwhen i was a kid\b",
        r"\b(?:was|is) (?:literally )?my childhood\b",
        r"\bgrew up with\b",
        r"\bsince i was \d+\b",
        r"\bremember playing\b",
        r"\bbrings me back\b",
    )),
)


def rules_for(
    series_names: Sequence[str] = (), awaited_title: str | None = None
) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The rules plus the two that name a franchise: ``new to <series>`` and ``where is <title>``.

    Names are regex fragments in lower case.
    """
    extra: dict[str, tuple[str, ...]] = {}
    if series_names:
        extra["new_customer_interest"] = (rf"\bnew to (?:{'|'.join(series_names)})\b",)
    if awaited_title:
        extra["frustrated_demand"] = (rf"\bwhere is {awaited_title}\b",)
    return tuple((label, patterns + extra.get(label, ())) for label, patterns in RULES)


def _first_characters(pattern: str) -> set[str] | None:
    """Characters a match can start with; None unless that is plain to see.

    Plain are ``\\b`` and then a letter, a digit, ``\\d`` or a group of such branches; nothing there may be optional
    and the pattern may have no alternatives outside groups.
    """
    if not pattern.startswith(r"\b"):
        return None
    body = pattern[2:]
    depth = 0
    for before, c in zip(" " + body, body):
        if before != "\\":
            depth += (c in "([") - (c in ")]")
            if c == "|" and not depth:
                return None
    if not body.startswith("(?:"):
        branches, rest = [body], ""
    else:
        inner, closed, rest = body[3:].partition(")")
        if not closed or "(" in inner or "[" in inner:
            return None
        branches = inner.split("|")
    if rest[:1] in tuple("?*{"):
        return None
    out: set[str] = set()
    for branch in branches:
        first, after = (branch[:2], branch[2:3]) if branch.startswith(r"\d") else (branch[:1], branch[1:2])
        if after in tuple("?*{") or not (first == r"\d" or first.isascii() and first.isalnum()):
            return None
        out |= set("0123456789") if first == r"\d" else {first}
    return out


def label_regex(patterns: Sequence[str]) -> str:
    """One regex that matches where one of the patterns, taken as they are, does.

    If the first characters of all of them are plain, a look-ahead on these runs before the costlier Unicode word-boundary
    test. ``(?U)``: boundaries and digits follow Unicode, so accented letters count as letters.
    """
    starts = [_first_characters(p) for p in patterns]
    if any(s is None for s in starts):
        return "(?U)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    bodies = "|".join(p.removeprefix(r"\b") for p in patterns)
    return rf"(?U)(?=[{''.join(sorted(set().union(*starts)))}])\b(?:{bodies})"


def intent_label(text: Column, rules=RULES) -> Column:
    """First rule set with a match, else general discussion. One regex per label."""
    subject = F.trim(casefold(F.coalesce(text, F.lit(""))))
    hits = [F.when(subject.rlike(label_regex(patterns)), F.lit(label)) for label, patterns in rules]
    return F.coalesce(*hits, F.lit(GENERAL))


def intent_confidence(label: Column) -> Column:
    """Fixed indicator of the rule classifier; never a probability."""
    return F.when(label == GENERAL, F.lit(RULE_MISS_CONFIDENCE)).otherwise(
        F.lit(RULE_HIT_CONFIDENCE)
    )


def is_actionable(label: Column, strict: bool = False) -> Column:
    """Null for labels outside the taxonomy, or an error when ``strict``."""
    unknown = (
        F.raise_error(F.concat(F.lit("Unknown taxonomy label: "), label)).cast("boolean")
        if strict
        else F.lit(None).cast("boolean")
    )
    return (
        F.when(label.isin(*ACTIONABLE_CLASSES), F.lit(True))
        .when(label == GENERAL, F.lit(False))
        .when(label.isNotNull(), unknown)
    )


def sentiment_label(compound: Column) -> Column:
    """Positive / neutral / negative by compound score."""
    return (
        F.when(compound >= POSITIVE_FROM, "positive")
        .when(compound <= NEGATIVE_FROM, "negative")
        .otherwise("neutral")
    )
