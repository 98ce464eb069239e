"""Personal data by weak supervision, in Spark's own functions only.

Four base rules give spans that always stay. Looser rules propose further candidates;
labelers (rules, a gazetteer and context words) vote on every candidate, base ones too.
Expectation-maximisation over the counts of equal votes estimates how reliable each
labeler is, and the posteriors train a naive-Bayes classifier on a candidate's own shape.
The classifier decides which candidates become spans beside the base ones.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import stored

KINDS = ("email", "ip", "card", "phone")

#: The base rules. Possessive repeats and starts tied to the begin of a run change no match,
#: but keep long runs of digits, dots or letters linear and off the stack.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Looser rules: addresses without a dotted domain or spelled out, and groups of digits.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "phone": r"(?:\G|(?<![0-9]))[(]?[0-9][0-9().\x20-]{4,22}[0-9](?![0-9])",
}

#: Words that announce each kind of candidate, and words after which digits mean something else.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address)\W{0,4}(?:\w+\W{1,3})?$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|dial|ring|contact|card|account|ssn)\W{0,4}(?:\w+\W{1,3})?$",
}
OTHER = r"(?i)(?:version|v|page|chapter|section|isbn|issn|part|order|invoice|item|no|nr|id|#|\$|€|£)\W{0,3}$"

#: Gazetteer: domain ends of mail hosts, and trunk or country codes that open phone numbers.
DOMAIN_ENDS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|us|eu)$"
DIAL_CODES = r"^[(]?(?:00|0[1-9]|1[-. ][2-9])"

#: Code points of context that are read before a candidate.
CONTEXT = 32

_MARK = "\u0001"


def _spans(text: Column, rule: str, maybe: Column) -> Column:
    """Leftmost matches as ``array<struct<start, end, match>>`` in code points.

    One pass marks the matches, a split at the marks gives gaps and matches in turn, and
    their lengths give the places.
    """
    # a mark that the text itself holds becomes another control character, of the same length
    marked = F.regexp_replace(F.translate(text, _MARK, "\u0002"), f"({rule})", f"{_MARK}$1{_MARK}")
    parts = F.split(marked, _MARK, -1)
    kind = "array<struct<start:bigint,end:bigint,match:string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("hit"), F.array().cast(kind).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        upto = acc["at"] + F.length(part)
        hit = F.struct(acc["at"].alias("start"), upto.alias("end"), part.alias("match"))
        return F.struct(upto.alias("at"), (~acc["hit"]).alias("hit"),
                        F.when(acc["hit"], F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    return F.when(maybe, F.aggregate(parts, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(kind))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    number = _digits(match)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, "[.]"), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(number).between(12, 19), _luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(9, 15)
    return F.lit(True)


def _holder(kind: str):
    return lambda s: _holds(kind, s["match"])


def _numbered(spans: Column, no: int, **more: Column) -> Column:
    extra = [value.alias(name) for name, value in more.items()]
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), s["match"].alias("match"), *extra))


def base_spans(text: Column) -> Column:
    """``array<struct<start, no, end>>`` of the base rules by start, then kind as listed."""
    digit = text.rlike("[0-9]")
    maybe = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit,
             "phone": digit & F.contains(text, F.lit("+"))}
    found = []
    for no, kind in enumerate(KINDS):
        found.append(_numbered(F.filter(_spans(text, RULES[kind], maybe[kind]), _holder(kind)), no))
    return F.array_sort(F.concat(*found))


def _candidates(text: Column, base: Column) -> Column:
    """Base spans and loose matches that meet none, with votes and shape: ``(start, no, end, base, votes, shape)``.

    ``votes`` has a digit for each labeler: 0 against, 1 silent, 2 for.
    """
    maybe = {"email": F.contains(text, F.lit("@")) | F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)")),
             "phone": text.rlike("[0-9]")}
    pools = [F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"),
                                                  s["match"].alias("match"), F.lit(True).alias("base")))]
    for kind in LOOSE:
        no = KINDS.index(kind)
        loose = F.filter(_spans(text, LOOSE[kind], maybe[kind]), lambda s: ~F.exists(
            base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        if kind == "phone":
            loose = F.filter(loose, lambda s: F.length(_digits(s["match"])).between(7, 19))
        pools.append(_numbered(loose, no, base=F.lit(False)))

    def judged(s: Column) -> Column:
        match, mail = s["match"], s["no"] == 0
        before = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)).cast("int"),
                             F.least(s["start"], F.lit(CONTEXT)).cast("int"))
        n = F.length(_digits(match))
        vote = lambda yes, no: F.when(yes, 2).when(no, 0).otherwise(1)
        votes = (vote(s["base"], F.lit(False)),
                 vote(F.when(mail, before.rlike(CUES["email"])).otherwise(before.rlike(CUES["phone"])), before.rlike(OTHER)),
                 vote(F.when(mail, match.rlike(DOMAIN_ENDS)).otherwise(match.rlike(DIAL_CODES)), mail & ~match.rlike(r"\.|dot")),
                 vote(F.when(mail, match.rlike("^[A-Za-z][A-Za-z0-9._%+-]*@")).otherwise(match.rlike(r"[0-9][ ().-]+[0-9]+[ ().-]+[0-9]")),
                      ~mail & ((n < 9) | (n > 16) | match.rlike("^[0-9]+$"))))
        shape = F.concat_ws("/", s["no"], F.least(n, F.lit(20)), F.least(F.floor(F.length(match) / 6), F.lit(6)),
                            F.least(F.length(F.regexp_replace(match, "[^ ().-]", "")), F.lit(4)),
                            F.when(match.rlike(DOMAIN_ENDS), 1).otherwise(0))
        return F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s["base"].alias("base"),
                        F.concat(*[v.cast("string") for v in votes]).alias("votes"), shape.alias("shape"))

    return F.transform(F.concat(*pools), judged)


def fit_votes(counts: dict[str, float], rounds: int = 40) -> dict[str, float]:
    """Posterior of each vote pattern by expectation-maximisation (two hidden classes).

    At most 3 ** labelers patterns. The first labeler starts as the most reliable.
    """
    if not counts:
        return {}
    width = len(next(iter(counts)))
    prior = 0.5
    rate = {c: [{"0": 0.15, "1": 0.35, "2": 0.5} if c else {"0": 0.4, "1": 0.5, "2": 0.1} for _ in range(width)] for c in (0, 1)}
    rate[1][0], rate[0][0] = {"0": 0.05, "1": 0.15, "2": 0.8}, {"0": 0.2, "1": 0.78, "2": 0.02}
    post: dict[str, float] = {}
    for _ in range(rounds):
        for p in counts:
            like = {c: (prior if c else 1 - prior) * math.prod(rate[c][i][v] for i, v in enumerate(p)) for c in (0, 1)}
            post[p] = like[1] / (like[0] + like[1])
        for c in (0, 1):
            weight = {p: n * (post[p] if c else 1 - post[p]) for p, n in counts.items()}
            total = sum(weight.values())
            for i in range(width):
                for v in "012":
                    rate[c][i][v] = (sum(w for p, w in weight.items() if p[i] == v) + 0.5) / (total + 1.5)
        prior = min(max(sum(n * post[p] for p, n in counts.items()) / sum(counts.values()), 0.01), 0.99)
    return post


def fit_shapes(rows: list[tuple[str, str, int]], post: dict[str, float]) -> dict[str, float]:
    """Naive Bayes over the parts of a shape, trained on soft labels: probability by shape."""
    total = [1.0, 1.0]
    seen: list[dict] = [defaultdict(float), defaultdict(float)]
    for votes, shape, n in rows:
        for c in (0, 1):
            w = n * (post[votes] if c else 1 - post[votes])
            total[c] += w
            for i, part in enumerate(shape.split("/")):
                seen[c][i, part] += w
    out = {}
    for shape in {s for _, s, _ in rows}:
        odds = math.log(total[1] / total[0]) + sum(
            math.log((seen[1][i, part] + 0.5) / (total[1] + 1)) - math.log((seen[0][i, part] + 0.5) / (total[0] + 1))
            for i, part in enumerate(shape.split("/")))
        out[shape] = 1 / (1 + math.exp(-max(min(odds, 60), -60)))
    return out


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
                 with_rows: bool = False) -> DataFrame:
    """``doc_id, base, spans`` of every row: arrays of ``(start, no, end)``, places in code points.

    ``spans`` holds all of ``base`` and the added candidates that the classifier gives at
    least ``threshold``; these never meet a base span. Whole texts are read, null ones as
    empty; repeated rows give repeated results; an empty table gives none. ``with_rows``
    adds the input row as struct ``row``, so extra columns of any name are safe. The model
    is fitted on the counts of all candidates; distinct votes and shapes are few, whatever
    the number of rows.
    """
    own = [F.struct("*").alias("row")] if with_rows else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("_text"), *own)
    rows = rows.withColumn("_base", base_spans(F.col("_text")))
    judged = rows.withColumn("_all", _candidates(F.col("_text"), F.col("_base"))).drop("_text", "_base")
    judged = stored(judged)
    counted = judged.select(F.explode("_all").alias("c")).groupBy("c.votes", "c.shape").count().collect()
    table = [(r["votes"], r["shape"], r["count"]) for r in counted]
    votes: dict[str, float] = defaultdict(float)
    for v, _, n in table:
        votes[v] += n
    chances = fit_shapes(table, fit_votes(dict(votes)))
    chosen = F.array(*[F.lit(s) for s in sorted(s for s, p in chances.items() if p >= threshold)]).cast("array<string>")
    bare = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(
        s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"))))
    return judged.select("doc_id", bare(F.filter("_all", lambda s: s["base"])).alias("base"),
                         bare(F.filter("_all", lambda s: s["base"] | F.array_contains(chosen, s["shape"]))).alias("spans"),
                         *(["row"] if with_rows else []))


def kind_count(spans: Column, no: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["no"] == no)).cast("long")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["no"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    kind = "struct<at:bigint,out:string>"
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.get(names, s["no"]))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")).cast(kind)
    return F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
