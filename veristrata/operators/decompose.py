"""Conclusions to atomic claims (1 -> N), as a partition-wise table function.

Sentences split at conjunctions outside parentheses; each clause keeps the sentence's
hedge flag and its population, comparator, time and setting where the sentence has one
of the kind.  What a split still loses or adds is named in ``error``.  At most ``budget``
claims per report are checked; the overflow comes back as unchecked rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Abbreviations that keep their dot, and the cue words of the fields.
ABBREVIATIONS = ("e.g.", "i.e.", "vs.", "cf.", "al.", "fig.", "dr.", "no.")
CAUSAL_VERBS = "cause causes caused lead leads led result results resulted prevent prevents prevented".split()
ASSOCIATION_CUES = "associated association correlated correlation linked".split()
HEDGES = "may might could possibly probably likely suggests suggest appears appear".split()
QUANTITY = re.compile(r"\d+(?:\.\d+)?\s?(?:%|mg|kg|g|ml|mm|cm|years?|days?|weeks?|months?|hours?|fold)?")
POPULATION = re.compile(r"\b(?:in|among)\s+((?:[\w-]+\s){0,4}?(?:patients|adults|children|women|men|mice|rats|cells|participants|subjects|people))\b", re.I)
COMPARATOR = re.compile(r"\b(?:compared (?:with|to)|than|versus|relative to)\s+([\w\s-]+?)(?=[,.;]|$)", re.I)
TIME = re.compile(r"\b(?:after|within|over|during|for)\s+(\d+\s\w+)", re.I)
# how a study was made: where, an article, up to two words on the design, and the kind of study
SETTING = re.compile(r"\b(?:(?:in|within)\s)?an?\s(?:[\w-]+\s){0,2}?(?:trial|cohort|registry|case-control\sstudy|meta-analysis)\b", re.I)
SHARED = {"population": POPULATION, "comparator": COMPARATOR, "time": TIME, "setting": SETTING}
CAUSAL = re.compile(rf"\b(?:{'|'.join(CAUSAL_VERBS)}|causing|causation|causal)\b", re.I)
HEDGE = re.compile(rf"\b(?:{'|'.join(HEDGES)})\b", re.I)
# words that carry an answer (direction, negation, hedge, assertion) or no topic; a neutral question has none of them
ANSWERS = re.compile(
    r"(?:increas|decreas|improv|reduc|lower|rais|higher|worsen|enhanc|caus|prevent|associat|correlat|link)\w*|leads?|led|results?|resulted|"
    rf"not|no|never|without|failed|did|does|do|was|were|is|are|had|has|have|be|{'|'.join(HEDGES)}|significantly|slightly|"
    r"a|an|the|it|its|this|that|and|or|also|of|to|in|among|for|with|by|at|on|from|than|versus|compared|relative",
    re.I,
)


def split_sentences(text: str) -> list[str]:
    out, start = [], 0
    for m in re.finditer(r"[.!?;](?=\s|$)", text):
        head = text[start : m.end()]
        if m.group() == "." and head.rsplit(None, 1)[-1:] and head.rsplit(None, 1)[-1].lower().lstrip("(") in ABBREVIATIONS:
            continue
        if head.strip():
            out.append(head.strip())
        start = m.end()
    if text[start:].strip():
        out.append(text[start:].strip())
    return out


def split_clauses(sentence: str) -> list[str]:
    """Parts joined by ', and', '; ' or ' and ' before a verb phrase, at parenthesis depth 0."""
    parts, depth, at = [], 0, 0
    for m in re.finditer(r"[()]|,\s+and\s+|\s+and\s+(?=(?:also|did|does|was|were|is|are|had|has|\w+ed|\w+s)\s)", sentence):
        if m.group() == "(":
            depth += 1
        elif m.group() == ")":
            depth = max(0, depth - 1)
        elif not depth and len(sentence[at : m.start()].split()) >= 3 and len(sentence[m.end() :].split()) >= 2:
            parts.append(sentence[at : m.start()].strip(" ,"))
            at = m.end()
    parts.append(sentence[at:].strip(" ,"))
    return [p for p in parts if p]


def _only(values: list[str]) -> str | None:
    return values[0].strip() if len(set(values)) == 1 else None


def modality(text: str) -> str:
    t = set(re.findall(r"[a-z]+", text.lower()))
    if t & set(ASSOCIATION_CUES):
        return "association"
    if re.search(r"\b(not|no|never|without|failed)\b", text.lower()):
        return "negation"
    if t & set(CAUSAL_VERBS):
        return "causal"
    return "magnitude" if QUANTITY.search(text) else "effect"


def question(text: str) -> str:
    """The topic words of a claim and its quantities, without what it asserts of them."""
    words = [w.strip(".,;:!?()\"'") for w in text.split()]
    topic = list(dict.fromkeys(w for w in words if w and not ANSWERS.fullmatch(w)))
    if not topic or len(words) < 2:  # a claim of one word is all answer
        return "What does the evidence show?"
    return f"What does the evidence show about: {' / '.join(topic)}?"


def _phrases(clauses: list[str]) -> dict[str, list[str]]:
    """The distinct phrases of each shared field; none reaches over a split."""
    return {k: list({m.group(0).strip().casefold(): m.group(0).strip() for c in clauses for m in p.finditer(c)}.values()) for k, p in SHARED.items()}


def violations(sentence: str, conclusion: str, phrases: dict[str, list[str]], rows: list[dict]) -> list[str | None]:
    """What each claim of a sentence, or all of them together, loses or adds; null for a kept claim."""
    texts = [r["normalized_claim"].casefold() for r in rows]
    whole = "\n".join(texts)
    common = [f"quantity {q.strip()!r} was dropped" for q in QUANTITY.findall(sentence) if q.strip().casefold() not in whole]
    common += [f"hedge {h!r} was dropped" for h in HEDGE.findall(sentence) if h.casefold() not in whole]
    common += [f"{k} {p!r} was dropped" for k, ps in phrases.items() if len(ps) > 1 for p in ps if p.casefold() not in whole]
    out = []
    for r, text in zip(rows, texts, strict=True):
        own = [f"quantity {q.strip()!r} was added" for q in QUANTITY.findall(r["normalized_claim"]) if q.strip().casefold() not in sentence.casefold()]
        if re.search(rf"(?<!\w){re.escape(r['normalized_claim'])}(?!\w)", r["neutral_question"]):
            own.append("the question gives the answer away")
        if r["exact_source_span"] != sentence or sentence not in conclusion:
            own.append("the span is no sentence of the source")
        if not CAUSAL.search(sentence) and (r["modality"] == "causal" or CAUSAL.search(f"{text} {r['neutral_question']}")):
            own.append("a cause was read into the text")
        # with several phrases of a kind a claim without one of them has lost its own
        for k, ps in phrases.items():
            if ps and not any(p.casefold() in text for p in ps):
                own.append(f"{k} {ps[0]!r} was dropped" if len(ps) == 1 else f"{k} is one of several")
        if HEDGE.search(sentence) and not r["hedged"]:
            own.append("hedge was dropped")
        out.append("; ".join(dict.fromkeys(common + own)) or None)
    return out


def claims_of(conclusion: str) -> list[dict]:
    rows: list[dict] = []
    for s, sentence in enumerate(split_sentences(conclusion)):
        first = len(rows)
        subject = None
        clauses = split_clauses(sentence.rstrip(".!?;"))
        phrases = _phrases(clauses)
        for clause in clauses:
            words = clause.split()
            text = clause
            if subject and words and re.match(r"(also|did|does|was|were|is|are|had|has|\w+ed|\w+s)$", words[0], re.I):
                text = f"{subject} {clause}"
            elif words:
                subject = subject or words[0]
            for ps in phrases.values():  # of several, none is known to be this clause's
                if len(ps) == 1 and ps[0].casefold() not in text.casefold():
                    text = f"{text} {ps[0]}"
            rows.append(
                {
                    "sentence": s,
                    "exact_source_span": sentence,
                    "normalized_claim": text,
                    "population": _only(POPULATION.findall(text)),
                    "comparator": _only(COMPARATOR.findall(text)),
                    "time": _only(TIME.findall(text)),
                    "units": ",".join(q.strip() for q in QUANTITY.findall(text)) or None,
                    "modality": modality(text),
                    "hedged": bool(HEDGE.search(sentence)),
                    "neutral_question": question(text),
                    "anchor": first,
                }
            )
        for row, error in zip(rows[first:], violations(sentence, conclusion, phrases, rows[first:]), strict=True):
            row["error"] = error
    return rows


SCHEMA = (
    "report_id string, claim_no int, checked boolean, sentence int, exact_source_span string, normalized_claim string, population string, "
    "comparator string, time string, units string, modality string, hedged boolean, neutral_question string, depends_on int, error string"
)


def decompose(reports: DataFrame, budget: int = 8) -> DataFrame:
    """(report_id, conclusion) -> one row per atomic claim."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for rid, text in zip(batch["report_id"], batch["conclusion"], strict=True):
                for i, c in enumerate(claims_of(text or "")):
                    depends = c["anchor"] if c["anchor"] != i else None
                    out.append({"report_id": rid, "claim_no": i, "checked": i < budget, "depends_on": depends} | {k: v for k, v in c.items() if k != "anchor"})
            frame = pd.DataFrame(out, columns=names)
            frame["depends_on"] = frame["depends_on"].astype("Int32")
            yield frame

    return reports.selectExpr("cast(report_id as string) report_id", "conclusion").mapInPandas(run, SCHEMA)
