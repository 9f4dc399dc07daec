"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.shared import bind, find_spans, no_spans, whole

KINDS = ("email", "ip", "card", "phone")
#: Characters on either side of a span that its context is.
CONTEXT = 40
THRESHOLD = 0.5

# Where a class run can only be matched from its start, the search is told so: a match begins
# at a run's start or right after the last match.
_EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
          r"(?:\.[A-Za-z0-9-]++)++")
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# What else may be personal data, to be voted on. Per kind, what a text must hold
# for a search, and the pattern.
LOOSE = {
    "email": (r"(?i)[\[(]at[\])]", r"(?i)[a-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[a-z0-9-]++"
              r"(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[a-z0-9-]++)++"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}"
           r"[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])"),
    "card": (r"[0-9]{4}\.[0-9]{4}", r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])"),
    "phone": (r"[0-9]{3}[-.\x20][0-9]{4}", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|"
              r"[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9.-])"),
}
# Gazetteers (which values are plausible) and words of the context for and against.
GAZETTEER = {
    "email": r"(?i)(?:\.|[\[(]dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl"
             r"|ch|at|be|ca|us)$",
    "ip": r"^(?!0+\.|10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|22[4-9]\."
          r"|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+[1-9]|\(?[2-9])",
}
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|contacto|correo|courriel|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login|client|serveur|servidor)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|karte|carte|tarjeta|payment|credit)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|anruf|t[ée]l[ée]phone|tel[ée]fono)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|order|invoice|ref|serial|build|section|figure|chapter)\b"

VOTES = ("shape", "gazetteer", "context", "border")
FEATURES = ("email", "ip", "card", "phone", "strict", "known", "cued", "against", "clean", "long")


def _luhn(digits):
    """Whether the check digit of a string of digits is right."""
    def step(total, i):
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        odd = (F.char_length(digits) - i) % 2 == 1
        return total + F.when(odd, twice).otherwise(digit)

    places = F.sequence(F.lit(1), F.char_length(digits))
    return F.aggregate(places, F.lit(0), step) % 10 == 0


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def strict_spans(text):
    """The base spans of each kind, in the order of KINDS."""
    def card(span):
        digits = _digits(span["value"])
        return F.char_length(digits).between(14, 19) & F.when(
            F.char_length(digits).between(14, 19), _luhn(digits)).otherwise(False)

    def when(hint, pattern):
        return F.when(hint, find_spans(text, pattern)).otherwise(no_spans())

    return {
        "email": when(F.contains(text, F.lit("@")), _EMAIL),
        "ip": F.filter(when(text.rlike(r"[0-9]\.[0-9]"), _IP), lambda s: s["value"].rlike(
            rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        "card": F.filter(when(text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), _CARD), card),
        "phone": F.filter(when(F.contains(text, F.lit("+")), _PHONE), lambda s: F.char_length(
            _digits(s["value"])).between(10, 15)),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """docs with ``spans``: kind (its number), start, end, value, strict, votes and features.

    Loose spans that overlap a strict one of their kind are left out.
    """
    text = whole(F.col("text"))
    both = []
    for number, (kind, strict) in enumerate(strict_spans(text).items()):
        hint, pattern = LOOSE[kind]
        loose = F.when(text.rlike(hint), find_spans(text, pattern)).otherwise(no_spans())
        both.append(_joined(number, strict, loose))
    found = bind(F.concat(*both), lambda spans: F.transform(
        spans, lambda s: _voted(text, s)))
    return docs.withColumn("spans", found)


def _joined(number, strict, loose):
    """Strict spans, and the loose ones that overlap none of them."""
    def rest(strict):
        return F.filter(loose, lambda x: ~F.exists(
            strict, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))

    return bind(strict, lambda found: F.concat(
        F.transform(found, lambda x: _marked(x, number, True)),
        F.transform(rest(found), lambda x: _marked(x, number, False))))


def _marked(span, number, strict):
    return F.struct(F.lit(number).alias("kind"), span["start"].alias("start"),
                    span["end"].alias("end"), span["value"].alias("value"),
                    F.lit(strict).alias("strict"))


def _voted(text, span):
    def by_kind(table, value):
        found = F.lit(False)
        for number, kind in enumerate(KINDS):
            found = F.when(span["kind"] == number, value.rlike(table[kind])).otherwise(found)
        return found

    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.substring(text, (begin + 1).cast("int"), (span["start"] - begin).cast("int"))
    after = F.substring(text, (span["end"] + 1).cast("int"), F.lit(CONTEXT))
    around = F.concat(before, F.lit(" "), after)
    known, cued = by_kind(GAZETTEER, span["value"]), by_kind(FOR, around)
    against = around.rlike(AGAINST)
    clean = ~(before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]"))

    def vote(yes, no):
        return F.when(yes, 1).when(no, -1).otherwise(0)

    votes = F.array(vote(span["strict"], F.lit(False)), vote(known, ~known),
                    vote(cued & ~against, against & ~cued), vote(clean, ~clean))
    flags = [*[span["kind"] == i for i in range(len(KINDS))], span["strict"], known, cued,
             against, clean, F.char_length(span["value"]) > 14]
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"),
                    span["end"].alias("end"), span["value"].alias("value"),
                    span["strict"].alias("strict"), votes.alias("votes"),
                    F.array(*[f.cast("int") for f in flags]).alias("features"))


def estimate(patterns, rounds=50):
    """EM over vote patterns {(kind, votes): n}: the chance that each is personal data.

    Each labeler has its own chances of voting for, against and not at all, given either truth;
    each kind its own prior. It begins from the mean of the votes.
    """
    belief = {p: 1 / (1 + math.exp(-1.5 * sum(p[1]))) for p in patterns}
    kinds, labelers = {p[0] for p in patterns}, range(len(VOTES))
    for _ in range(rounds):
        prior, rates = {}, {}
        for kind in kinds:
            mine = [p for p in patterns if p[0] == kind]
            yes = sum(patterns[p] * belief[p] for p in mine)
            prior[kind] = (yes + 1) / (sum(patterns[p] for p in mine) + 2)
        for truth in (0, 1):
            for j in labelers:
                seen = {-1: 1.0, 0: 1.0, 1: 1.0}
                seen[1 if truth else -1] += 2  # labelers are better than chance
                for p, n in patterns.items():
                    seen[p[1][j]] += n * (belief[p] if truth else 1 - belief[p])
                for vote, n in seen.items():
                    rates[truth, j, vote] = n / sum(seen.values())
        for p in patterns:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]])) + sum(
                math.log(rates[1, j, p[1][j]] / rates[0, j, p[1][j]]) for j in labelers)
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def train(examples, steps=400, rate=0.5, decay=1e-3):
    """Logistic regression on [(features, chance, n)]; intercept first."""
    weights = [0.0] * (len(FEATURES) + 1)
    total = sum(n for _, _, n in examples) or 1
    for _ in range(steps):
        slope = [decay * w for w in weights]
        for features, chance, n in examples:
            x = (1, *features)
            score = sum(w * v for w, v in zip(weights, x))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) - chance) * n / total
            for i, v in enumerate(x):
                slope[i] += error * v
        weights = [w - rate * s for w, s in zip(weights, slope)]
    return weights


def fit(docs: DataFrame):
    """The classifier's weights from the votes on all candidates in all documents.

    What comes back is how often each pattern of votes and features occurs; there are a few
    thousand at most, however many documents.
    """
    span = F.col("span")
    seen = candidates(docs.select("text")).select(F.explode("spans").alias("span")).groupBy(
        span["kind"].alias("kind"), span["votes"].alias("votes"),
        span["features"].alias("features")).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = {}
    for r in seen:
        key = (r.kind, tuple(r.votes))
        patterns[key] = patterns.get(key, 0) + r.n
    belief = estimate(patterns)
    return train(sorted((tuple(r.features), belief[r.kind, tuple(r.votes)], r.n) for r in seen))


def find(docs: DataFrame, weights=None) -> DataFrame:
    """docs with ``spans`` (kind, start, end, value, strict, score), by start, then kind.

    Every strict span stays; a loose one is added where the classifier gives it at least
    THRESHOLD. Offsets are code points, the end is exclusive. A null text has no spans; a
    column called spans is replaced; equal rows are each returned. ``weights`` are fitted on
    ``docs`` if not given. Nothing is shuffled but the counts of the fit.
    """
    weights = weights or fit(docs)

    def score(span):
        raw = F.aggregate(
            F.zip_with(span["features"], F.array(*[F.lit(float(w)) for w in weights[1:]]),
                       lambda x, w: x * w), F.lit(float(weights[0])), lambda a, b: a + b)
        return 1 / (1 + F.exp(-raw))

    scored = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("at"), s["end"].alias("end"),
        s["value"].alias("value"), s["strict"].alias("strict"), score(s).alias("score")))
    kept = F.sort_array(F.filter(scored, lambda s: s["strict"] | (s["score"] >= THRESHOLD)))
    names = F.array(*map(F.lit, KINDS))
    return candidates(docs).withColumn("spans", F.transform(kept, lambda s: F.struct(
        F.get(names, s["at"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["value"].alias("value"), s["strict"].alias("strict"), s["score"].alias("score"))))
