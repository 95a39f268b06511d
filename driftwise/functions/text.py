"""Text tests as column expressions, so they stay inside generated code."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.functions.columns import any_phrase

# Phrases that name a slice of the business, by dimension.
SCOPE_TERMS: dict[str, dict[str, str]] = {
    "channel": {
        "app": "app", "mobile app": "app", "android": "app", "ios": "app",
        "website": "web", "web": "web", "browser": "web", "desktop site": "web",
        "store": "store", "outlet": "store", "shop": "store", "footfall": "store",
    },
    "device": {
        "android": "mobile", "iphone": "mobile", "mobile": "mobile",
        "desktop": "desktop", "laptop": "desktop", "tablet": "tablet",
    },
    "category": {
        "personal care": "personal_care", "packaged food": "packaged_foods",
        "home care": "home_care", "beverage": "beverages", "snack": "snacks",
    },
}

# Complaint wordings, in the order they are tried.
ISSUE_TERMS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("checkout_failure", (
        "checkout fails", "checkout broken", "cannot complete checkout", "card entry",
        "card form", "card page", "unable to complete purchase", "cannot complete",
        "checkout flow", "payment page will not load", "payment page")),
    ("payment_failure", (
        "payment step", "cannot pay", "payment failed", "crashes at payment",
        "card declined", "transaction failed")),
    ("delivery_delay", (
        "delivery delayed", "arrived late", "delivery was late", "shipment stuck", "courier",
        "roads are closed", "no update for", "could not collect", "rainfall", "flooding",
        "flood", "storm", "store was shut", "footfall", "distribution centre",
        "closed because")),
    ("stockout", (
        "out of stock", "unavailability", "cannot find the product", "sold out", "no stock",
        "availability")),
    ("pricing", (
        "cheaper elsewhere", "price went up", "price of this item changed",
        "introductory offer", "price cut", "prices across", "cut personal care prices",
        "discount", "promotion")),
    ("quality", ("damaged", "packaging was torn", "quality was", "defective", "broken item")),
)
RESIDUAL_ISSUE = "other"

# Issues that can name a business event.
EVENT_ISSUES = ("checkout_failure", "payment_failure", "delivery_delay", "stockout", "pricing")

# Which complaints count as support for a note of each subject.
RELATED_ISSUES: dict[str, tuple[str, ...]] = {
    "checkout_failure": ("checkout_failure", "payment_failure"),
    "payment_failure": ("payment_failure", "checkout_failure"),
    "delivery_delay": ("delivery_delay", "stockout"),
    "stockout": ("stockout", "delivery_delay"),
    "pricing": ("pricing",),
    "quality": ("quality",),
    "other": (),
}

# Company words a customer would not use in a complaint.
NOT_IN_COMPLAINTS = (
    "release", "deployment", "rollout", "competitor", "supplier", "carrier",
    "distribution centre", "sop", "process", "planning",
)

# Categories of cause and the words that name them, in order. A
# trailing space asks for the whole word.
BONES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("competition", ("competitor", "rival", "market share")),
    ("external", (
        "weather", "rain", "flood", "storm", "cyclone", "heat", "monsoon", "strike", "bandh",
        "curfew", "regulation", "regulatory", "tax", "gst", "holiday", "election")),
    ("platform", (
        "release", "app ", "checkout", "payment", "gateway", "bug", "outage of", "system",
        "website", "card entry", "login", "software", "it outage")),
    ("price", (
        "price", "pricing", "discount", "tariff", "sku", "launch", "introductory", "mrp",
        "pack size", "assortment", "realisation")),
    ("demand", (
        "promotion", "promo", "campaign", "marketing", "media", "advert", "sale ", "festival",
        "footfall")),
    ("supply", (
        "stock", "supply", "carrier", "delivery", "fleet", "tanker", "refinery", "turnaround",
        "allocation", "indent", "plant", "outage", "grid", "transmission", "warehouse", "depot",
        "gantry", "shipment", "logistics")),
)
BONE_BY_KIND = {"release_log": "platform", "promotion": "demand"}

REMEDIATION = r"(?i)\b(roll(?:ed)?[- ]?back|revert(?:ed)?|hotfix(?:ed)?)\b"

# Patterns of instructions hidden in a record, and their label.
# Third, words one of which every match contains: a plain search for them skips
# the pattern on nearly all texts.
INJECTION_PATTERNS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    (r"ignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+\w*\s*instructions?",
     "override attempt", ("ignore",)),
    (r"disregard\s+(the\s+)?(above|previous|prior|system)", "override attempt", ("disregard",)),
    (r"forget\s+(everything|all|what)\s+(you|we)", "override attempt", ("forget",)),
    (r"you\s+are\s+now\s+(a|an)\s+", "role reassignment", ("now",)),
    (r"new\s+(system\s+)?(instructions?|prompt|rules?)\s*[:\-]", "instruction injection", ("new",)),
    (r"</?(system|instruction|prompt)>", "delimiter spoofing", ("<",)),
    (r"\bsystem\s*[:>]\s*", "delimiter spoofing", ("system",)),
    (r"(reveal|print|output|list|dump|show)\s+(all\s+|every\s+|the\s+)?"
     r"(customer|user|password|secret|api\s*key|token|credential)", "data exfiltration",
     ("customer", "user", "password", "secret", "api", "token", "credential")),
    (r"execute\s+(this|the following)\s+(sql|query|command|code)", "command injection", ("execute",)),
    (r"drop\s+table\b|delete\s+from\b|truncate\s+table\b", "sql in prose", ("table", "delete")),
    (r"do\s+not\s+(report|mention|include|flag)\s+", "suppression attempt", ("not",)),
)

# What a text must hold for a masking pattern to match at all.
AT_SIGN, DIGIT_RUN = "@", r"(?U)\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"

# Personal data, in the order it is masked.
PERSONAL_PATTERNS: tuple[tuple[str, str, str], ...] = (
    (r"[\w.+-]+@[\w-]+\.[\w.]+", "[email]", AT_SIGN),
    (r"\b[\w.-]{2,}@[a-zA-Z][a-zA-Z0-9]+\b(?![.@\w-])", "[upi]", AT_SIGN),
    (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[pan]", r"[0-9]{4}[A-Z]"),
    (r"\b(?:\d[ -]?){15,18}\d\b", "[card]", DIGIT_RUN),
    (r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b", "[card]", DIGIT_RUN),
    (r"(?:\+?91[ -]?)?\b[6-9]\d{4}[ -]?\d{5}\b", "[phone]", DIGIT_RUN),
    (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[id-number]", DIGIT_RUN),
)
LOCATION_PATTERNS: tuple[tuple[str, str, str], ...] = (
    (r"\b\d{1,4}[/,]?\s?[A-Z][a-z]+\s+(Road|Street|Marg|Nagar|Colony)\b", "[address]",
     r"(?:Road|Street|Marg|Nagar|Colony)"),
)
DOMAINS = {"pii": PERSONAL_PATTERNS, "location": LOCATION_PATTERNS}

FENCE, FENCE_END = "<<<DOCUMENT>>>", "<<<END DOCUMENT>>>"


def longest_term(text: Column, terms: Mapping[str, str]) -> Column:
    """What the longest whole phrase present stands for; null when none is.

    Plurals count. One scan tries the phrases, longest first, at every word
    start without consuming text, so phrases that overlap are all seen; of equal
    lengths the one named first wins.
    """
    phrases = list(terms)
    tried = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: -len(p)))
    pattern = rf"(?<![a-z0-9])(?=({tried})(?:s|es)?(?![a-z0-9]))"
    named = F.array(*[F.lit(p) for p in phrases])
    values = F.array(*[F.lit(v) for v in terms.values()])
    hits = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
    best = F.array_max(F.transform(hits, lambda p: F.struct(
        F.length(p).alias("size"), (-F.array_position(named, p)).alias("place"))))
    return F.get(values, (-best["place"] - 1).cast("int"))


def issue_of(text: Column, terms: Sequence[tuple[str, tuple[str, ...]]] = ISSUE_TERMS,
             residual: str = RESIDUAL_ISSUE) -> Column:
    """The first issue, in vocabulary order, one of whose wordings is present."""
    return F.coalesce(*[
        F.when(text.rlike("(?i)" + "|".join(re.escape(w) for w in wordings)), F.lit(issue))
        for issue, wordings in terms], F.lit(residual))


def issue_place(lowered: Column, issue: Column,
                terms: Sequence[tuple[str, tuple[str, ...]]] = ISSUE_TERMS) -> Column:
    """1-based place of the issue's first wording found, in vocabulary order."""
    return F.coalesce(*[
        F.when(issue == name, F.coalesce(
            *[F.nullif(F.instr(lowered, F.lit(w)), F.lit(0)) for w in wordings]))
        for name, wordings in terms], F.lit(1))


def bone(kind: Column, description: Column) -> Column:
    """Category of cause: by record kind, else by the first category word."""
    body = F.concat(F.lit(" "), F.lower(F.regexp_replace(
        F.coalesce(description, F.lit("")), r"^[^:\s]{1,32}:\s*", "")), F.lit(" "))
    by_kind = [F.when(kind == k, F.lit(b)) for k, b in BONE_BY_KIND.items()]
    by_word = []
    for name, words in BONES:
        pattern = "|".join(
            r"\b" + re.escape(w.strip()) + (r"\b" if w.endswith(" ") else "") for w in words)
        by_word.append(F.when(body.rlike(pattern), F.lit(name)))
    return F.coalesce(*by_kind, *by_word, F.lit("other"))


def identifier(text: Column, doc_id: Column) -> Column:
    """The reference a note opens with: the last token holding a digit before the
    colon of a short head, else the first word, else the document's own id."""
    head = F.substring_index(text, ":", 1)
    tokens = F.transform(F.split(F.trim(head), r"\s+"),
                         lambda t: F.regexp_replace(t, r"^[.,;]+|[.,;]+$", ""))
    numbered = F.filter(tokens, lambda t: t.rlike(r"\d"))
    short_head = F.contains(text, F.lit(":")) & (F.length(head) <= 60) & (F.size(numbered) > 0)
    first = F.element_at(F.split(text, r"[:\s]", 2), 1)
    return F.when(short_head, F.element_at(numbered, -1)) \
        .when(first != "", first).otherwise(F.concat(F.lit("doc-"), doc_id.cast("string")))


def version_of(candidate_id: Column) -> Column:
    return F.nullif(F.regexp_extract(candidate_id, r"(\d+(?:\.\d+)+|\d{2,})", 1), F.lit(""))


def injection_flags(text: Column) -> Column:
    """Labels of hidden instructions found, each once, in pattern order."""
    lowered = F.lower(text)
    return F.array_distinct(F.array_compact(F.array(*[
        F.when(any_phrase(lowered, musts) & text.rlike("(?i)" + unicode_aware(pattern)), F.lit(label))
        for pattern, label, musts in INJECTION_PATTERNS])))


def unicode_aware(pattern: str) -> str:
    """Word and digit classes over all scripts, not ASCII alone."""
    return "(?U)" + pattern


def may_match(text: Column, must: str) -> Column:
    return F.contains(text, F.lit(must)) if must == AT_SIGN else text.rlike(must)


def redact(text: Column, domains: Sequence[str]) -> Column:
    """Personal data masked. Texts that cannot match any pattern are left alone.

    Each step names the text once: naming it more often would double the whole
    chain with every step.
    """
    steps = [step for domain in domains for step in DOMAINS.get(domain, ())]
    masked = text
    for pattern, placeholder, _ in steps:
        masked = F.regexp_replace(masked, unicode_aware(pattern), placeholder)
    needed = F.lit(False)
    for must in dict.fromkeys(must for _, _, must in steps):
        needed = needed | may_match(text, must)
    return F.when(needed, masked).otherwise(text)


def redacted(frame: DataFrame, domains: Sequence[str], text: str = "text") -> DataFrame:
    """The frame with its text masked and ``masked`` telling what was, and how often.

    One masking step per column: each is counted on the text as it then stands,
    and no step is worked out twice.
    """
    told = []
    for domain in domains:
        for step, (pattern, placeholder, must) in enumerate(DOMAINS.get(domain, ())):
            name = f"_{domain}_{step}"
            found = F.when(may_match(F.col(text), must), F.regexp_count(
                F.col(text), F.lit(unicode_aware(pattern)))).otherwise(0)
            frame = frame.withColumn(name, found).withColumn(text, F.when(
                F.col(name) > 0, F.regexp_replace(F.col(text), unicode_aware(pattern), placeholder))
                .otherwise(F.col(text)))
            told.append((name, f"{domain}:{placeholder.strip('[]')} x"))
    masked = F.array_compact(F.array(*[
        F.when(F.col(name) > 0, F.concat(F.lit(label), F.col(name).cast("string")))
        for name, label in told]))
    return frame.withColumn("masked", masked).drop(*[name for name, _ in told])


def quarantined(text: Column, domains: Sequence[str] = ()) -> Column:
    """The whole text made safe to quote: redacted, fences and control marks neutralised.

    Flags must be read from the original, not from this.
    """
    safe = redact(text, domains)
    safe = F.replace(F.replace(safe, F.lit(FENCE), F.lit("[fence]")), F.lit(FENCE_END), F.lit("[fence]"))
    return F.regexp_replace(safe, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def bare(piece: Column) -> Column:
    """A piece without the separator run that ends it."""
    return F.regexp_replace(piece, r"(?<=[.!?])\s+$", "")


def complaint_query(description: Column, company_words: Sequence[str] = NOT_IN_COMPLAINTS) -> Column:
    """A note reworded as a customer might: short, company and coded words gone."""
    colon = F.instr(F.substring(description, 1, 40), ":")
    body = F.when(colon > 0, F.substr(description, colon + 1)) \
        .otherwise(description)
    words = F.filter(
        F.split(F.trim(F.lower(body)), r"\s+"),
        lambda w: (F.length(w) > 3) & ~w.rlike("|".join(re.escape(t) for t in company_words))
        & ~w.rlike(r"[\d_]|-\w+-"))
    kept = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;]+|[.,;]+$", "")), " ")
    return F.when(kept != "", kept).otherwise(body)
