"""Personal data in whole texts: base rules, high-recall candidates and boosted trees, in DataFrame functions only.

Base spans come from four fixed patterns with exact validators and always stay. Three loose generators propose further,
overlapping candidates (obfuscated addresses, separated digit groups, dotted quads with odd separators). A candidate's format
and the words around it give binary features. Boosted trees, one set a kind, score the candidates; nothing else adds a span.

Training candidates are right where they touch a base span of their kind, and where they are an obfuscation made from a base span
of the documents or from a few fixed examples ("@" as "(at)", other separators, no "+"), found again by the generators. They are
wrong where their normalised form fails the kind's validator, in fixed counter-examples (dates, lists, decimals), and where no
right candidate shows the same features. Counts per feature pattern enter by their logarithm, so that a form is judged alike
however often it occurs. Of the documents, every fifth text only calibrates: the threshold of a kind is the lowest score from which
on at least ``PRECISION`` of these candidates are right. Candidates above it that touch no base span compete where they overlap;
the higher score wins.

The feature table is one aggregation of all candidates by kind and feature bits: a table whose size is bounded by the number
of bit patterns. Trees become column expressions. Positions are code points, from the lengths of the pieces between matches.

Defined cases: a null text is the empty text and has no spans; rows are independent, so equal texts and repeated rows give
equal results and null ids stay null; an empty table gives no rows; other columns are kept by ``with_spans`` and ignored by
``find_personal_data``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import stored, whole_text

KINDS = ("email", "ip", "card", "phone")
# fixed patterns; possessive where nothing that follows could take characters back, so long runs stay linear
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
MARK = {"email": "@", "ip": ".", "card": "", "phone": "+"}
# loose generators: pattern and the kinds that they may stand for; a local part has at most 64 characters (as mail allows), a number at
# most 31 digits (the longest valid one has 19)
LOOSE = {
    "address": (rf"[{_LOCAL}]{{1,64}}+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]++(?:(?:\.| \. | ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)++", ("email",)),
    "digits": (r"[+(]?[0-9](?:[\x20().\-/]{0,2}+[0-9]){8,30}+", ("card", "phone")),
    "quad": (r"[0-9]{1,3}(?:[\x20.\[\]():-]{1,3}+[0-9]{1,3}){3}", ("ip",)),
}
TREES = 32
RATE = 0.4
PRECISION = 0.98
# examples that join the obfuscated base spans, and texts without personal data
EXAMPLES = (
    ("email", "first.last@mail.example.org"), ("ip", "10.20.30.40"), ("card", "4111 1111 1111 1111"), ("card", "5500-0000-0000-0004"), ("phone", "+1 202 555 0143"), ("phone", "+44 20 7946 0958"),
)
COUNTER_EXAMPLES = (
    "on 2020-01-02 10-11-13 there", "from 2024.01.02 10:11:12 on", "points 1. 2. 3. 4 follow", "pages 100-200, 300-400", "about 0.123456789012 more", "sum 1 000 000 000 000 now",
    "code 4111.1111.1111.1112 here", "code 1234 5678 9012 3456 here", "code 1234-5678-9012-3457", "lunch @ noon. Then home", "sold 3 @ 4.50 each", "met @ noon . Then left", "best (at) 2.5 points", "meet@5.30 sharp", "v 1.2.3.400 out", "from 300[.]0[.]0[.]7 on", "3 - 4 - 5 - 6 left",
)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """Whether 14 to 19 digits pass the check sum."""
    d = F.reverse(_digits(hit))

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.when(F.length(d).between(14, 19), F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0).otherwise(False)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda h: F.lit(True),
    "ip": lambda h: h.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda h: F.length(_digits(h)).between(10, 15),
}


def _spans(text: Column, pattern: str, may: Column, made: Callable[[Column, Column, Column, Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Array of ``made(start, end, hit, before, after)`` for the leftmost matches whose condition holds."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    rows = F.zip_with(rows, F.slice(gaps, 2, F.size(hits)), lambda x, g: F.struct(x["hit"].alias("hit"), x["gap"].alias("gap"), g.alias("next")))
    none = F.lit(None).cast(f"array<{kind}>")
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        keep, value = made(begin, end, x["hit"], x["gap"], x["next"])
        return F.struct(end.alias("pos"), F.when(keep, F.array_append(acc["out"], value)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(rows, start, step, lambda acc: acc["out"])
    return F.coalesce(F.when(may, found).otherwise(none), F.array().cast(f"array<{kind}>"))


def _said_before(before: Column, words: str) -> Column:
    return F.right(before, F.lit(24)).rlike(rf"(?i)(?<![a-z])(?:{words})[^\p{{L}}\p{{N}}]*$")


def _address_features(hit: Column, before: Column, after: Column) -> dict[str, Column]:
    return {
        "at_marker": hit.rlike(r"[(\[]at[)\]]"), "blank_at": hit.rlike(r" @|@ "), "dot_marker": hit.rlike(r"[(\[]dot[)\]]"), "blank_dot": hit.contains(" . "), "suffix": hit.rlike(r"[. )\]][A-Za-z]{2,63}$"),
        "mail_word": _said_before(before, "e-?mails?|mail|contact|address|write to"), "blank_before": (before == "") | before.rlike(r"\s$"), "sign_after": after.rlike(r"^[^\s\p{L}\p{N}.,;:]"),
    }


def _digit_features(hit: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.length(_digits(hit))
    return {
        "plus_first": hit.startswith("+"), "bracket": hit.rlike(r"[()]"), "blank": hit.contains(" "), "dash": hit.contains("-"), "dot": hit.contains("."), "slash": hit.contains("/"),
        "digits_10_15": n.between(10, 15), "digits_14_19": n.between(14, 19), "check_sum": _luhn(hit), "fours": hit.rlike(r"^[0-9]{4}([^0-9]{1,2})[0-9]{4,6}(?:\1[0-9]{3,5})+$"),
        "three_three_four": hit.rlike(r"^\+?(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4})$"),
        "phone_word": _said_before(before, "tel|telephone|phone|call|fax|mobile|(?:phone|fax|mobile) (?:number|no)"), "card_word": _said_before(before, "card|visa|account|(?:card|account) (?:number|no)"),
    }


def _quad_features(hit: Column, before: Column, after: Column) -> dict[str, Column]:
    return {
        "dot_marker": hit.rlike(r"[(\[]\.[)\]]"), "blank_dot": hit.contains(" . "), "dot_blank": hit.rlike(r"[^ ]\. "), "plain": hit.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "other": hit.rlike("[:-]"),
        "equal": hit.rlike(r"^[0-9]+([^0-9]+)[0-9]+(?:\1[0-9]+){2}$"), "bytes": VALID["ip"](F.regexp_replace(hit, "[^0-9]+", ".")), "host_word": _said_before(before, "ip|host|server|ip address"), "sign_after": after.rlike(r"^[^\s\p{L}\p{N}.,;:]"),
    }


FEATURES: dict[str, Callable[[Column, Column, Column], dict[str, Column]]] = {"address": _address_features, "digits": _digit_features, "quad": _quad_features}
N_FEATURES = {"email": 8, "ip": 9, "card": 13, "phone": 13}


def _bits(generator: str, hit: Column, before: Column, after: Column) -> Column:
    bits = F.lit(0)
    for i, t in enumerate(FEATURES[generator](hit, before, after).values()):
        bits = bits + F.when(t, 1 << i).otherwise(0)
    return bits


def _plain_address(hit: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(hit, r" ?[(\[]at[)\]] ?", "@"), r" ?[(\[]dot[)\]] ?", ".")
    return F.regexp_replace(F.regexp_replace(plain, r" \. ", "."), " ?@ ?", "@").rlike(rf"^[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?<=\.[A-Za-z]{{2,63}})$")


# whether a candidate's normalised form is valid
NORMAL: dict[str, Callable[[Column], Column]] = {"email": _plain_address, "ip": lambda h: VALID["ip"](F.regexp_replace(h, "[^0-9]+", ".")), "card": _luhn, "phone": VALID["phone"]}

SPAN = "struct<start:int,end:int,kind:int>"
CANDIDATE = "struct<start:int,end:int,kind:int,bits:int,valid:int>"


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base`` (valid base spans by start, then kind) and ``_loose`` (candidates with their feature bits)."""
    t = whole_text(text)
    digits = t.rlike("[0-9]")
    parts = []
    for k, name in enumerate(KINDS):
        may = (F.contains(t, F.lit(MARK[name])) if MARK[name] else F.lit(True)) & (digits if name != "email" else F.lit(True))
        parts.append(_spans(t, BASE[name], may, lambda b, e, h, x, y, k=k, name=name: (VALID[name](h), F.struct(b.alias("start"), e.alias("end"), F.lit(k).alias("kind"))), SPAN))
    loose = []
    for name, (pattern, kinds) in LOOSE.items():
        may = (F.contains(t, F.lit("@")) | t.rlike(r"[(\[]at[)\]]")) if name == "address" else digits
        valid = lambda h, kinds=kinds: sum((F.when(NORMAL[k](h), 1 << KINDS.index(k)).otherwise(0) for k in kinds), F.lit(0))
        made = lambda b, e, h, x, y, name=name, valid=valid: (F.lit(True), F.struct(b.alias("start"), e.alias("end"), F.lit(0).alias("kind"), _bits(name, h, x, y).alias("bits"), valid(h).alias("valid")))
        found = _spans(t, pattern, may, made, CANDIDATE)
        for kind in kinds:
            loose.append((F.lit(KINDS.index(kind)), found, name, kind))
    names = {}
    for _, found, name, _ in loose:
        names.setdefault(f"_found_{name}", found)
    df = df.withColumns({"_parts": F.concat(*parts)} | names)
    copies = [_as_kind(f"_found_{name}", k) for k, _, name, _ in loose]
    return df.withColumns({"_base": F.array_sort("_parts", _by_place), "_loose": F.concat(*copies)}).drop("_parts", *names)


def _as_kind(found: str, k: Column) -> Column:
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), k.cast("int").alias("kind"), c["bits"].alias("bits"), c["valid"].alias("valid")))


def _is_valid(c: Column) -> Column:
    return c["valid"].bitwiseAND(F.call_function("shiftleft", F.lit(1), c["kind"])) != 0


def _number_of(k: int) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")


def _by_place(a: Column, b: Column) -> Column:
    less = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.coalesce(less(a["start"], b["start"]), less(a["kind"], b["kind"]), less(a["end"], b["end"]), F.lit(0))


def _touches(c: Column, spans: Column | str, same_kind: bool) -> Column:
    return F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]) & ((s["kind"] == c["kind"]) if same_kind else F.lit(True)))


@dataclass
class Booster:
    """Trees of two levels over feature bits for one kind, the score from which on candidates are taken, and what that gave in calibration."""

    trees: list[tuple[int, int, int, list[float]]] = field(default_factory=list)
    prior: float = 0.0
    threshold: float = math.inf
    recall: float = 0.0
    precision: float = 1.0

    def score(self, bits: int) -> float:
        return self.prior + sum(v[2 * (bits >> a & 1) + (bits >> (c if bits >> a & 1 else b) & 1)] for a, b, c, v in self.trees)

    def column(self, bits: Column) -> Column:
        total = F.lit(self.prior)
        on = lambda i: bits.bitwiseAND(1 << i) != 0
        for a, b, c, v in self.trees:
            total = total + F.when(on(a), F.when(on(c), v[3]).otherwise(v[2])).otherwise(F.when(on(b), v[1]).otherwise(v[0]))
        return total


def _leaf(rows: list[tuple[float, float]]) -> tuple[float, float]:
    g, h = sum(r[0] for r in rows), sum(r[1] for r in rows) + 1.0
    return g / h, g * g / h


def fit_booster(table: list[tuple[int, float, float, float, float]], features: int = 13) -> Booster:
    """``table``: bits, weight of right and wrong candidates of the training documents, of right and wrong of the calibration ones."""
    right, wrong = sum(r[1] for r in table), sum(r[2] for r in table)
    model = Booster(prior=math.log((right + 1) / (wrong + 1)))
    if not right or not (wrong + sum(r[4] for r in table)):
        return model  # one class only: nothing to learn from
    scores = {r[0]: model.prior for r in table}
    for _ in range(TREES):
        grad = []
        for bits, p, n, *_ in table:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, scores[bits]))))
            grad.append((bits, p - (p + n) * q, (p + n) * q * (1 - q)))
        best = None
        for a in range(features):
            sides, gain = [], 0.0
            for value in (0, 1):
                mine = [r for r in grad if r[0] >> a & 1 == value]
                options = []
                for b in range(features):
                    low, high = (_leaf([r[1:] for r in mine if r[0] >> b & 1 == v]) for v in (0, 1))
                    options.append((low[1] + high[1], -b, low[0], high[0]))
                top = max(options)
                gain += top[0]
                sides.append(top)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, a, sides)
        _, a, sides = best
        tree = (a, -sides[0][1], -sides[1][1], [RATE * sides[0][2], RATE * sides[0][3], RATE * sides[1][2], RATE * sides[1][3]])
        model.trees.append(tree)
        for bits in scores:
            a, b, c, v = tree
            scores[bits] += v[2 * (bits >> a & 1) + (bits >> (c if bits >> a & 1 else b) & 1)]
    good = bad = seen_good = seen_bad = 0
    ranked = sorted(table, key=lambda r: -scores[r[0]])
    for i, (bits, tp, tn, p, n) in enumerate(ranked):
        good, bad, seen_good, seen_bad = good + p, bad + n, seen_good + tp, seen_bad + tn
        share = (seen_good + 0.5) / (seen_good + seen_bad + 1)
        ends = i + 1 == len(ranked) or scores[ranked[i + 1][0]] < scores[bits]
        if ends and good + share >= PRECISION * (good + bad + 1):
            model.threshold, model.recall, model.precision = scores[bits], good / max(1e-9, sum(r[3] for r in table)), good / max(1e-9, good + bad)
    return model


EVIDENCE = "struct<kind:int,bits:int,right:boolean,hit:string,before:string,after:string>"


def _evidence(docs: DataFrame, text: str) -> DataFrame:
    """Per candidate: kind, feature bits and whether it is right (null: not known); per base span: the span with its surroundings."""
    found = with_candidates(docs.select(F.col(text).alias("text"))).withColumn("fold", F.pmod(F.xxhash64(whole_text()), F.lit(5)) == 0)
    right = lambda c: F.when(_touches(c, "_base", True), True).when(~_is_valid(c), False)
    named = lambda **cols: F.struct(*[v.alias(k) for k, v in cols.items()]).cast(EVIDENCE)
    none, t = F.lit(None), whole_text()
    seen = F.transform("_loose", lambda c: named(kind=c["kind"], bits=c["bits"], right=right(c), hit=none, before=none, after=none))
    spans = F.transform("_base", lambda s: named(
        kind=s["kind"], bits=none, right=none, hit=F.substr(t, s["start"] + 1, s["end"] - s["start"]),
        before=F.substr(t, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))), after=F.substr(t, s["end"] + 1, F.lit(8)),
    ))
    return found.select("fold", F.explode(F.concat(seen, spans)).alias("e")).select("fold", "e.*")


def _obfuscated() -> Column:
    """Forms of the span ``hit``: arrays of (before, form)."""
    hit, before, digits = F.col("hit"), F.col("before"), _digits(F.col("hit"))
    form = lambda said, x: F.struct(said.alias("before"), x.alias("form"))
    user, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    as_dots = lambda x, dot: F.regexp_replace(x, r"\.", dot)
    address = [
        form(before, F.concat(user, F.lit(" (at) "), as_dots(host, " (dot) "))), form(before, F.concat(user, F.lit(" [at] "), as_dots(host, " [dot] "))), form(before, F.concat(user, F.lit("(at)"), host)),
        form(before, F.concat(user, F.lit("@"), as_dots(host, "(dot)"))), form(F.lit("email: "), F.concat(user, F.lit(" @ "), host)), form(F.lit("contact "), F.concat(user, F.lit(" @ "), as_dots(host, " . "))),
    ]
    quad = [form(before, as_dots(hit, x)) for x in ("[.]", "(.)", " . ")] + [form(F.lit("ip "), as_dots(hit, x)) for x in ("-", " ", ":")]
    fours = lambda sep: F.regexp_replace(digits, "(?<=[0-9])(?=(?:[0-9]{4})+$)", sep)
    card = [form(before, F.regexp_replace(digits, "^([0-9]{4})([0-9]{4})([0-9]{4})([0-9]+)$", f"$1{x}$2{x}$3{x}$4")) for x in (".", "/", ". ")] + [form(F.lit("card "), fours(x)) for x in ("/", ".", " - ")]
    last = F.right(digits, F.lit(10))
    tens = lambda pattern: F.regexp_replace(last, "^([0-9]{3})([0-9]{3})([0-9]{4})$", pattern)
    phone = [form(before, tens(x)) for x in ("$1-$2-$3", "$1.$2.$3", "($1) $2-$3", "$1 $2 $3")] + [form(F.lit(w), x) for w in ("phone: ", "call ") for x in (F.regexp_replace(hit, r"\+", ""), digits, tens("$1-$2-$3"), F.regexp_replace(hit, "[ -]", "."))]
    by_kind = {"email": address, "ip": quad, "card": card, "phone": phone}
    return F.element_at(F.array(*[F.array(*by_kind[k]) for k in KINDS]), F.col("kind") + 1)


def _examples(evidence: DataFrame) -> DataFrame:
    """Candidates in obfuscations of base spans and in the fixed examples: fold, kind, bits, right."""
    spark = evidence.sparkSession
    fixed = spark.createDataFrame([(fold, KINDS.index(k), hit, before, " x") for fold in (True, False) for k, hit in EXAMPLES for before in ("", "at ")], "fold boolean, kind int, hit string, before string, after string")
    spans = evidence.filter("hit IS NOT NULL").select("fold", "kind", "hit", "before", "after").unionByName(fixed)
    made = spans.select("fold", F.col("kind").alias("own"), "after", F.explode(_obfuscated()).alias("f")).select("fold", "own", F.length("f.before").alias("low"), F.length(F.concat("f.before", "f.form")).alias("high"), F.concat("f.before", "f.form", "after").alias("text"))
    covers = lambda c: (c["kind"] == F.col("own")) & (c["start"] <= F.col("low")) & (c["end"] >= F.col("high"))
    right = with_candidates(made).select("fold", F.explode(F.filter("_loose", covers)).alias("c")).select("fold", "c.kind", "c.bits", F.lit(True).alias("right"))
    counter = spark.createDataFrame([(fold, t) for fold in (True, False) for t in COUNTER_EXAMPLES], "fold boolean, text string")
    wrong = with_candidates(counter).select("fold", F.explode("_loose").alias("c")).select("fold", "c.kind", "c.bits", F.lit(False).alias("right"))
    return right.unionByName(wrong)


def _weighed(p: int, n: int, u: int, known: bool) -> tuple[float, float]:
    """Weights of a pattern; candidates of unknown label are wrong where no right one shows the pattern."""
    return math.log2(1 + p), math.log2(1 + n + (0 if known else u))


def train(docs: DataFrame, text: str = "text") -> dict[int, Booster]:
    """One pass over the documents; every fifth text (by hash) calibrates."""
    evidence = stored(_evidence(docs, text), "evidence")
    rows = evidence.filter("bits IS NOT NULL").select("fold", "kind", "bits", "right").unionByName(_examples(evidence))
    count = lambda fold, c: F.count_if((F.col("fold") == fold) & c)
    right = F.col("right")
    kinds = {"p": right.eqNullSafe(True), "n": right.eqNullSafe(False), "u": right.isNull()}
    table = rows.groupBy("kind", "bits").agg(*[count(fold, c).alias(f"{name}{int(fold)}") for fold in (False, True) for name, c in kinds.items()])
    by_kind: dict[int, list[tuple[int, float, float, float, float]]] = {}
    for r in sorted(table.collect()):  # bounded by the number of bit patterns: 2^13 for the kinds with most features
        known = r["p0"] + r["p1"] > 0
        by_kind.setdefault(r["kind"], []).append((r["bits"], *_weighed(r["p0"], r["n0"], r["u0"], known), *_weighed(r["p1"], r["n1"], r["u1"], known)))
    return {kind: fit_booster(t, N_FEATURES[KINDS[kind]]) for kind, t in by_kind.items()}


def with_spans(df: DataFrame, models: dict[int, Booster], text: str = "text") -> DataFrame:
    """Adds ``_base`` and ``_spans``: base spans, and both kinds of spans by start, kind and end."""
    found = with_candidates(df, text)
    live = {k: m for k, m in models.items() if m.threshold < math.inf}

    def scored(c: Column) -> Column:
        """Score above the threshold of the kind, null below it."""
        over = F.lit(None).cast("double")
        for k, m in live.items():
            over = F.when(c["kind"] == k, m.column(c["bits"]) - F.lit(m.threshold)).otherwise(over)
        return F.struct((-over).alias("order"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))

    free = F.filter("_loose", lambda c: ~_touches(c, F.col("_base"), False))
    best = F.array_sort(F.filter(F.transform(free, scored), lambda c: c["order"] <= 1e-9))
    span = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))
    none = F.array().cast(f"array<{SPAN}>")
    extra = F.aggregate(best, none, lambda taken, c: F.when(_touches(c, taken, False), taken).otherwise(F.array_append(taken, span(c))))
    return found.withColumn("_spans", F.array_sort(F.array_distinct(F.concat("_base", F.coalesce(extra, none))), _by_place)).drop("_loose")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, counts of base spans, digest of the base spans, all spans."""
    found = with_spans(docs.select("doc_id", "text"), train(docs))
    counts = [_number_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("_base").cast("binary"), 256).alias("base_sha256"), _listed("_spans").alias("spans"))


def redact(docs: DataFrame, models: dict[int, Booster], text: str = "text") -> DataFrame:
    """Replaces every span by its kind in brackets; overlapping spans become one replacement. A null text stays null."""
    found = with_spans(docs, models, text)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))

    def step(acc: Column, s: Column) -> Column:
        open_ = s["start"] >= acc["pos"]
        piece = F.concat(acc["out"], F.substr(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.get(labels, s["kind"]))
        return F.struct(F.when(open_, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos"))

    made = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["pos"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size("_spans") > 0, made).otherwise(t)).drop("_base", "_spans")
