"""Cleaning and extraction from texts as column expressions (E02-E34, E40). No UDFs.

Patterns are written so that Java's and RE2's engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
EXPLICIT = {
    "pricing_inquiry": [r"what\s+(is|are|would)\s+the\s+(price|cost|pricing|fee)", r"how\s+much\s+(does|would|will)\s+(it|this|that)\s+cost", r"what.*typical\s+(ROI|return\s+on\s+investment)",
                        r"what\s+does.*subscription\s+include", r"pricing\s+(structure|model|tiers)", r"what.*budget.*require"],
    "implementation": [r"what\s+does.*implementation.*look\s+like", r"how\s+(soon|quickly)\s+can\s+we\s+(get\s+started|begin|deploy)", r"what.*timeline\s+for\s+(deployment|implementation|rollout)",
                       r"when\s+can\s+we\s+(go\s+live|launch|start)", r"onboarding\s+process"],
    "comparison": [r"how\s+does\s+(this|your\s+solution)\s+compare\s+to\s+(\w+)", r"what.*different\s+from\s+(\w+)", r"(advantages|benefits)\s+(over|versus|compared\s+to)\s+(\w+)", r"why\s+should\s+we\s+choose\s+you\s+over"],
}
IMPLICIT = {
    "pain_points": [r"(struggling|challenge|problem|issue|difficulty)\s+with", r"(need|looking\s+for|seeking)\s+(a\s+solution|help|way\s+to)", r"currently\s+using.*but\s+(it'?s|lacking|missing)",
                    r"this\s+(could|would|might)\s+(really\s+)?help\s+(us|with)", r"we'?re\s+(having|facing)\s+(issues|problems)"],
    "dissatisfaction": [r"(frustrated|unhappy|dissatisfied)\s+with", r"current\s+(system|vendor|solution)\s+is\s+(too\s+)?(slow|expensive|limited)", r"lack(s|ing)\s+(features|capabilities|functionality)",
                        r"not\s+(happy|satisfied)\s+with\s+(our\s+)?(current|existing)"],
    "future_pacing": [r"(if|when)\s+we\s+had\s+this", r"imagine\s+(if|that|we\s+could)", r"we\s+could\s+(reduce|improve|increase|save).*by", r"this\s+would\s+allow\s+us\s+to"],
}
ENGAGEMENT = {
    "next_steps": [r"let'?s\s+(schedule|set\s+up)\s+(another|a\s+follow-up)\s+meeting", r"can\s+we\s+(meet|talk)\s+again", r"i'?ll\s+(connect\s+you|introduce\s+you)\s+to\s+(my\s+team|stakeholders)",
                   r"need\s+to\s+(discuss|review|run\s+this\s+by)\s+this\s+with\s+(my\s+)?team", r"send\s+(me|us)\s+(information|a\s+proposal)"],
    "detailed_questioning": [r"can\s+you\s+(explain|clarify|elaborate|walk\s+me\s+through)", r"what\s+about\s+(edge\s+cases|integration|customization|security)", r"how\s+does.*handle\s+(\w+)", r"tell\s+me\s+more\s+about"],
    "consensus": [r"(let'?s|we\s+should)\s+align\s+on", r"are\s+we\s+(in\s+)?agreement", r"have\s+we\s+reached\s+(a\s+)?consensus", r"sounds\s+good", r"that\s+makes\s+sense"],
}
OBJECTIONS = {
    "price": [r"(too|very)\s+expensive", r"over\s+(our\s+)?budget", r"cost\s+is\s+(a\s+)?concern", r"price\s+is\s+(too\s+)?high", r"can'?t\s+afford"],
    "timing": [r"not\s+(the\s+right|a\s+good)\s+time", r"too\s+soon", r"wait\s+until\s+(next\s+)?(year|quarter)", r"busy\s+with\s+other\s+projects"],
    "authority": [r"need\s+approval", r"not\s+my\s+decision", r"speak\s+with\s+(my\s+)?boss", r"decision\s+maker"],
    "competition": [r"happy\s+with\s+(current|existing)", r"already\s+have\s+a\s+solution", r"competitor\s+is\s+cheaper", r"switching\s+costs"],
}
#: Intents after the objections, first match first.
INTENTS = [
    ("inquiring_price", r"\b(price|cost|pricing)\b", 0.9), ("budget_discussion", r"budget", 0.85), ("stating_problem", r"(problem|issue|challenge|struggle|struggling|difficult|pain|trouble)", 0.85),
    ("expressing_dissatisfaction", r"(current|existing|incumbent).*\b(slow|expensive|limited|lacking|poor)|(frustrated|unhappy|dissatisfied|not\s+happy)\s+with", 0.85),
    ("requesting_demo", r"(demo|demonstration|show\s+me|walk\s+me\s+through|can\s+you\s+show)", 0.9), ("timeline_inquiry", r"(when|timeline|how\s+soon|how\s+quickly|how\s+long|implementation|deployment|go\s+live|launch)", 0.8),
    ("competitor_comparison", r"(compare|versus|vs\.|different\s+from|advantage\s+over|better\s+than|why\s+choose|cheaper|more\s+expensive)", 0.85),
    ("agreeing_next_steps", r"(next\s+steps|follow\s+up|schedule|meet\s+again|let'?s\s+talk|reach\s+out)", 0.8), ("feature_inquiry", r"(can\s+it|does\s+it\s+support|what\s+about|feature|capability|functionality)", 0.75),
    ("technical_question", r"(how\s+does|technical|integration|api|architecture|infrastructure|security)", 0.75)]
STAGE_HINTS = [("po_in_progress", r"po"), ("quote", r"rfq|quote"), ("integration", r"integration"), ("research", r"research")]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def any_of(text: Column, patterns: list[str]) -> Column:
    """One alternation per category, so that a text is scanned once for it."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def signal_hits(text: Column, groups: dict[str, list[str]]) -> Column:
    """How many of the categories a turn hits."""
    return sum((any_of(text, p).cast("int") for p in groups.values()), F.lit(0))


def signal_score(explicit: Column, implicit: Column, engagement: Column) -> Column:
    """Of a conversation's hits."""
    one = F.lit(1.0)
    return 0.4 * F.least(explicit / 3, one) + 0.3 * F.least(implicit / 5, one) + 0.3 * F.least(engagement / 4, one)


def intent(text: Column) -> Column:
    """Objections first, then the ordered rules, else off topic."""
    out = F.lit("off_topic")
    for name, pattern, _ in reversed(INTENTS):
        out = F.when(text.rlike("(?i)" + pattern), name).otherwise(out)
    return F.when(any_of(text, [p for ps in OBJECTIONS.values() for p in ps]), "raising_objection").otherwise(out)


def html_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; breaks and paragraphs as lines; entities read."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tidy(text: Column) -> Column:
    """E06 without Unicode forms: no control characters, single blanks, shorter runs of signs, at most two line ends."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), r"\t", " "), r" {2,}", " ")
    for pattern, short in ((r"!{3,}", "!!"), (r"\?{3,}", "??"), (r"\.{4,}", "..."), (r"-{4,}", "---"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, short)
    return F.trim(F.regexp_replace(out, r"(?m)^ +| +$", ""))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def quote_share(text: Column) -> Column:
    """Percent of lines that are quoted."""
    ls = lines(text)
    return F.round(F.size(F.filter(ls, lambda x: F.trim(x).startswith(">"))) * 100 / F.size(ls), 4)


def unsigned(text: Column) -> Column:
    """The text before a signature delimiter, or else before a closing phrase in the last ten lines."""
    cut = F.split(text, r"(?m)^-- ?$", 2)[0]
    ls = lines(cut)
    start = F.greatest(F.size(ls) - 10, F.lit(0))
    tail = F.transform(ls, lambda x, i: F.when((i >= start) & F.lower(F.trim(x)).rlike(r"^(best|kind|warm)? ?(regards|wishes),?$|^(thanks|cheers|sincerely|thank you),?$"), i))
    at = F.array_min(tail)
    return F.trim(F.array_join(F.when(at.isNull(), ls).otherwise(F.slice(ls, 1, F.greatest(at, F.lit(0)))), "\n"))


def quality_score(text: Column) -> Column:
    """0 to 1: replacement characters take off up to .5 and control characters up to .3; the share of common characters weighs half; a share of
    other than ASCII characters beyond .3 takes off half of what is beyond."""
    n = F.greatest(F.length(text), F.lit(1))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    kept = 1.0 - F.least(F.lit(0.5), count(r"\x{FFFD}") * 0.01) - F.least(F.lit(0.3), count(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") * 0.01)
    foreign = count(r"[^\x00-\x7F]") / n
    score = kept * (0.5 + count(r"[a-zA-Z0-9\s.,!?;:'\"()-]") / n * 0.5) - F.when(foreign > 0.3, (foreign - 0.3) * 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def keywords(text: Column, words: list[str]) -> Column:
    """The listed words that the text contains, in the listed order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words]))


def stage_hint(text: Column) -> Column:
    """Plain substrings, by precedence."""
    out = F.lit("unknown")
    for name, pattern in reversed(STAGE_HINTS):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def linked_text(html: Column) -> Column:
    """Links as [text](url)."""
    return F.regexp_replace(html, r'(?i)<a\s+(?:[^>]*?\s+)?href="([^"]*)"[^>]*>(.*?)</a>', r"[$2]($1)")


def is_html(text: Column) -> Column:
    """Whether a text holds a tag."""
    return F.coalesce(text.rlike(r"(?i)<[a-z][\s\S]*>"), F.lit(False))
