"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans, which always stay.  Looser patterns give candidates.
Labelers vote on each span: the strict pattern, a gazetteer (domains, country codes, card
prefixes, address ranges), the words before it, and its edges.  Expectation-maximisation
over the counts of vote patterns (a table of bounded size) estimates each labeler's
reliability without labels; the posteriors train a naive Bayes span classifier on votes and
span features, which decides on the candidates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[a-z0-9-]{1,63}+"
#: Base patterns.  Possessive repeats and edge tests keep them linear in the text; they
#: match the same spans as the plain patterns.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms: written-out signs, other separators, national phone numbers, ports.
LOOSE = {
    "email": rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:\x20?(?:\(at\)|\[at\])\x20?{_LABEL}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20){_LABEL})++|\x20at\x20{_LABEL}(?:\x20dot\x20{_LABEL})++)",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\x20?(?:\.|\[\.\]|\(\.\))\x20?){3}[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}([._/\x20-]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Gazetteers: top-level domains; first octets in public use; card prefixes; country calling codes.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot\W*)(?:com|org|net|edu|gov|info|biz|io|dev|app|de|fr|es|it|uk|us|eu|ch|at|nl|be|ca|mx|br|ar|jp|cn|in|au)$",
    "ip": r"^0*(?:[1-9]|[1-9][0-9]|1[01][0-9]|12[0-68-9]|1[3-9][0-9]|2[01][0-9]|22[0-3])\D",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6[0245])",
    "phone": r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9]",
}
#: Cue words before a span, in four languages.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt|schreib\w*|contacto)\b",
    "ip": r"(?i)\b(?:ip|ipv4|host|server|address|addr|login|client|adresse|direcci[oó]n)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta|cc)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono|anruf\w*)\b",
}
LABELERS = ("pattern", "gazetteer", "context", "edges")
#: Features that the classifier sees besides the votes.
FEATURES = ("digits", "signs", "length")

SPAN = "struct<start:int,end:int,base:boolean,votes:array<int>,features:array<int>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern passes its check."""
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _plain(kind: str, m: Column) -> Column:
    """A candidate written as the base pattern has it, for its check."""
    return F.regexp_replace(m, r"[\[\]()\x20]", "") if kind == "ip" else m


def _matches(text: Column, pattern: str) -> Column:
    """Non-overlapping matches as array of (start, end, m), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))
        return F.struct(end.alias("pos"), F.concat(acc["out"], one).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(g.alias("gap"), m.alias("m")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])


def _spans(text: Column, kind: str) -> Column:
    """All spans of one kind with votes and features: base ones, then candidates that overlap none of these."""
    none = F.array().cast(f"array<{SPAN}>")

    def judged(x: Column, base: bool) -> Column:
        m, digits = x["m"], F.length(_digits(x["m"]))
        before = F.substring(text, F.greatest(x["start"] - 29, F.lit(1)), F.least(x["start"], F.lit(30)))
        around = F.concat(F.substring(F.concat(F.lit(" "), before), -1, 1), F.lit("|"), F.substring(text, x["end"] + 1, F.lit(1)))
        strict = F.lit(base) | F.lit(kind in ("ip", "card"))
        known = (_digits(m) if kind == "card" else m).rlike(GAZETTEER[kind])
        votes = [
            F.when(strict, 1).otherwise(-1),
            F.when(known, 1).otherwise(-1),
            F.when(before.rlike(CUES[kind]), 1).otherwise(0),
            F.when(around.rlike(r"^[\w@]\||\|[\w@]$"), -1).otherwise(1),
        ]
        features = [F.least(digits, F.lit(20)), F.least(F.length(F.regexp_replace(m, r"\w", "")), F.lit(12)), F.least(F.length(m) / 4, F.lit(20.0)).cast("int")]
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), F.array(*votes).alias("votes"), F.array(*features).alias("features"))

    def part(pattern: str, base: bool, gate: Column) -> Column:
        kept = F.filter(_matches(text, pattern), lambda x: valid(kind, x["m"] if base else _plain(kind, x["m"])))
        return F.when(gate & text.rlike(pattern), F.transform(kept, lambda x: judged(x, base)).cast(f"array<{SPAN}>")).otherwise(none)

    digit = text.rlike("[0-9]")
    gate = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}[kind]
    wide = text.rlike(r"(?i)[(\[\x20](?:at|dot)[)\]\x20]") if kind == "email" else digit
    return F.struct(part(BASE[kind], True, gate).alias("base"), part(LOOSE[kind], False, wide).alias("loose"))


def _apart(pair: Column) -> Column:
    """Base spans with the candidates that overlap none of them."""
    base = pair["base"]
    free = F.filter(pair["loose"], lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return F.array_sort(F.concat(base, free))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one column ``pii_<kind>`` of spans for each kind; null texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.withColumns({f"pii_{k}": _spans(text, k) for k in KINDS})
    return raw.withColumns({f"pii_{k}": _apart(F.col(f"pii_{k}")) for k in KINDS})


@dataclass
class SpanModel:
    """Log odds: ``prior`` by kind, ``weight`` by (kind, feature number, value); ``reliability`` of labelers."""

    prior: dict[str, float] = field(default_factory=dict)
    weight: dict[tuple[str, int, int], float] = field(default_factory=dict)
    reliability: dict[tuple[str, str], float] = field(default_factory=dict)

    def log_odds(self, kind: str, span: Column) -> Column:
        total = F.lit(float(self.prior.get(kind, 0.0)))
        inputs = F.concat(span["votes"], span["features"])
        for j in range(len(LABELERS) + len(FEATURES)):
            known = [(v, w) for (k, i, v), w in self.weight.items() if (k, i) == (kind, j)]
            if known:
                table = F.create_map(*[F.lit(x) for v, w in known for x in (v, float(w))])
                total = total + F.coalesce(F.element_at(table, F.element_at(inputs, j + 1)), F.lit(0.0))
        return total

    def spans(self, kind: str) -> Column:
        """The spans to report: base ones, and candidates that the classifier accepts."""
        return F.filter(F.col(f"pii_{kind}"), lambda s: s["base"] | (self.log_odds(kind, s) > 0))


def fit(found: DataFrame, rounds: int = 8) -> SpanModel:
    """Reliabilities by expectation-maximisation, then the span classifier.

    ``found`` comes from ``candidates``.  All spans are counted by (kind, votes, feature
    number, value) in one aggregation.  As a posterior depends on kind and votes alone,
    the rounds need no more than these counts: at most a few thousand whatever the
    corpus (64 kinds of votes, 63 values of votes and features).
    """

    def named(k: str) -> Column:
        return F.transform(F.col(f"pii_{k}"), lambda s: F.struct(F.lit(k).alias("kind"), s["votes"].alias("votes"), s["features"].alias("features")))

    spans = found.select(F.explode(F.concat(*map(named, KINDS))).alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count(F.lit(1)).alias("n"))
    rows = spans.select("kind", "votes", "n", F.posexplode(F.concat("votes", "features")).alias("j", "v"))
    counts = sorted((r.kind, tuple(r.votes), r.j, r.v, r.n) for r in rows.groupBy("kind", "votes", "j", "v").agg(F.sum("n").alias("n")).collect())

    def learn(posterior: dict[tuple, float], inputs: int) -> SpanModel:
        model, sums, totals = SpanModel(), {}, {}
        for kind, votes, j, v, n in counts:
            if j < inputs:
                p = posterior[kind, votes]
                a, b = sums.get((kind, j, v), (0.0, 0.0))
                sums[kind, j, v] = (a + n * p, b + n * (1 - p))
        for (kind, j, _), (a, b) in sums.items():
            t = totals.get((kind, j), (0.0, 0.0, 0))
            totals[kind, j] = (t[0] + a, t[1] + b, t[2] + 1)
        for (kind, j, v), (a, b) in sorted(sums.items()):
            all_a, all_b, m = totals[kind, j]
            model.weight[kind, j, v] = math.log((a + 1) / (all_a + m + 1)) - math.log((b + 1) / (all_b + m + 1))
            model.prior[kind] = math.log((all_a + 1) / (all_b + 1))
            if j < len(LABELERS) and v == 1:
                model.reliability[kind, LABELERS[j]] = (a + 1) / (a + b + 2)
        return model

    def posterior(model: SpanModel) -> dict[tuple, float]:
        odds = {(k, votes): model.prior[k] + sum(model.weight[k, j, v] for j, v in enumerate(votes)) for k, votes in seen}
        return {s: 1 / (1 + math.exp(-x)) for s, x in odds.items()}

    seen = {(r[0], r[1]) for r in counts}
    model = learn({(k, votes): 0.9 if sum(votes) >= 2 else 0.6 if sum(votes) > 0 else 0.1 for k, votes in seen}, len(LABELERS))
    for _ in range(rounds):
        model = learn(posterior(model), len(LABELERS))
    final = learn(posterior(model), len(LABELERS) + len(FEATURES))
    final.reliability = model.reliability
    return final


def text_of(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every document.

    Returns id, n_<kind> (base spans), base_sha256 (of the base spans) and spans (all,
    kind:start:end in code points, by kind, then start).  Null and empty texts have no
    span; repeated rows return as often as they occur; an empty table gives an empty
    result; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialize(candidates(slim).drop("text"), "pii")
    model = fit(found)
    base = {k: F.filter(F.col(f"pii_{k}"), lambda s: s["base"]) for k in KINDS}
    joined = F.concat_ws(",", *[text_of(base[k], k) for k in KINDS])
    return found.select(
        F.col("id").alias(id_col),
        *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined, 256).alias("base_sha256"),
        F.concat_ws(",", *[text_of(model.spans(k), k) for k in KINDS]).alias("spans"),
    )


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in angle brackets; overlapping spans count as one.

    Null texts stay null and empty ones empty; rows and other columns, of any name, stay
    as they are; an empty table gives an empty result.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("text"))
    # written once, with its spans: the model is fitted on them and then decides on them
    found = materialize(candidates(packed).drop("text"), "pii-spans")
    model = fit(found)

    def marks(k: str) -> Column:
        return F.transform(model.spans(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{k}>").alias("mark")))

    text = F.col("doc")[text_col]

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["pos"]
        more = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), s["mark"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(inside, acc["out"]).otherwise(more).alias("out"))

    first = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    masked = F.aggregate(F.col("every"), first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    marked = found.select("doc", F.array_sort(F.concat(*map(marks, KINDS))).alias("every"))
    marked = marked.select("doc", F.when(F.size("every") > 0, masked).otherwise(text).alias("masked"))
    return marked.select(*[F.col("masked" if c == text_col else f"doc.`{c}`").alias(c) for c in docs.columns])
