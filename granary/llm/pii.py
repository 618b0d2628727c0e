"""PII by candidate gradient boosting, with DataFrame functions alone: generators propose spans, boosted trees judge them, base rules always hold."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import others, stored

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = "A-Za-z0-9._%+-"
# The base patterns, with possessive runs and a start at a run's beginning (or where the last match ended), so that they take linear time and match the same.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Generators beside these: numbers in groups, addresses with at and dot spelled out, and what is assigned to a name for a secret.
GROUPED = r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9][0-9 ./-]{4,18}[0-9](?![0-9A-Za-z])"
SPELLED = rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)++"
_NAME = "(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)"
SECRET = rf"(?<={_NAME}[\"']{{0,1}}\s{{0,3}}[:=]\s{{0,3}}[\"']{{0,1}})(?<![\w+/=-])[\w+/=-]{{8,}}+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _is_card(m: Column) -> Column:
    return F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(False)


def _is_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


@dataclass(frozen=True)
class Generator:
    kind: str
    pattern: str
    wanted: str  # a text without a match of this has none of the pattern
    base: object = None  # of a match, whether the base rules take it
    worth: object = None  # of a match, whether it is a candidate at all


GENERATORS = (
    Generator("email", EMAIL, "@", lambda m: F.lit(True)),
    Generator("ip", IP, r"[0-9]\.[0-9]", _is_ip),
    Generator("card", CARD, "[0-9]", _is_card, lambda m: F.length(m) >= 12),
    Generator("phone", PHONE, r"\+[0-9]", lambda m: F.length(_digits(m)).between(10, 15)),
    Generator("phone", GROUPED, "[0-9]"),
    Generator("email", SPELLED, r"[\[(](?:at|AT)[\])]"),
    Generator("secret", SECRET, _NAME),
)
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,m:string,before:string,after:string,base:boolean>>"


def _once(make: Callable[[Column], Column], *values: Column) -> Column:
    """make of a struct of the values, which are computed once each, however often make uses them, in lambdas too."""
    return F.get(F.transform(F.array(F.struct(*values)), make), F.lit(0))


def _matches(text: Column, g: Generator) -> Column:
    """The generator's candidates, leftmost and not overlapping, with places in code points (end exclusive) and what stands around them."""
    between, found = F.split(text, g.pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0)).alias("found")
    each = lambda v: F.arrays_zip(v["between"].alias("gap"), F.concat(v["found"], F.array(F.lit(None).cast("string"))).alias("m"), F.concat(F.slice(v["between"], 2, 2**31 - 2), F.array(F.lit(""))).alias("next"))

    def step(state: Column, x: Column) -> Column:
        gap, m, after = x["gap"], x["m"], x["next"]
        start = state["at"] + F.char_length(gap)
        end = start + F.coalesce(F.char_length(m), F.lit(0))
        base = g.base(m) if g.base else F.lit(False)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(g.kind)).alias("rank"), F.lit(g.kind).alias("kind"), end.alias("end"), m.alias("m"), F.right(gap, F.lit(16)).alias("before"), F.left(after, F.lit(1)).alias("after"), base.alias("base"))
        take = m.isNotNull() & (g.worth(m) if g.worth else F.lit(True))
        return F.struct(end.alias("at"), F.when(take, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    empty = F.array().cast(_SPAN)
    spans = _once(lambda v: F.aggregate(each(v), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"]), between, found)
    return F.when(text.rlike(g.wanted), spans).otherwise(empty)


FEATURES = 23
# Numbers that are surely none to call: after words for ids, dates and decimals.
_COUNTED = r"(?:\b(?:id|no|nr|order|invoice|isbn|card|visa|iban|account|serial|version|date|ref)|#)[^\p{L}]*$"
_DATED = r"^(?:[0-9]{4}[ ./-]{1,2}[0-9]{1,2}[ ./-]{1,2}[0-9]{1,2}|[0-9]{1,2}[ ./-]{1,2}[0-9]{1,2}[ ./-]{1,2}[0-9]{4}|[0-9]+\.[0-9]+)(?:$|[^0-9])"
# Made spans: what stands before them, and their forms, in which # is a digit, @ a small letter, ? a letter or digit and $ a hexadecimal digit.
MADE = {
    ("phone", True): (
        ["", "", "tel ", "Tel.: ", "phone: ", "call me at ", "my number is ", "mobile ", "reach us on ", "unter ", "fax ", "numéro ", "ring "],
        ["(0##) ###-####", "(0##) ### ####", "0### #######", "0##/#######", "0### ### ####", "###-###-####", "0# ## ## ## ##", "(###) ###-####", "0##-########", "0#### / ######", "00## ### #######"],
    ),
    ("phone", False): (
        ["", "", "order no ", "invoice ", "on ", "isbn ", "ref. ", "id ", "version ", "from ", "am ", "total "],
        ["20##-0#-1#", "1#.0#.20##", "1#/1#/20##", "###.#####", "19## - 20## - 20##", "978-#-##-######-#", "#### #### #### ####", "#### #### ####", "4###-####-####-####", "###-###-###", "20## 1# 0#", "##.##.## ##", "20##-1#-2# 1#"],
    ),
    ("email", True): (
        ["", "", "mail ", "write to ", "contact: ", "an ", "reach me: "],
        ["@@@@ [at] @@@@@@@ [dot] com", "@@@@@.@@@@ (at) @@@@@@ (dot) org", "@@@@@@(at)@@@@@@.de", "@@@@@ [at] @@@@@@@.net", "@@@##[at]@@@@@.@@@@@@.fr", "@@@_@@@@ [AT] @@@@@@ [DOT] co [DOT] uk"],
    ),
    ("email", False): (["", "", "we ", "they ", "then "], ["look (at) this.Then", "arrive [at] 1#.30", "point (at) fig.#", "stay [at] home.And", "@@@@ (at) ##.##", "meet [at] @@@@.We"]),
    ("secret", True): (
        ["token = ", "password: ", "api_key=", "secret: ", "access_key = ", "PASSWORD="],
        ["?" * 16, "?" * 20, "?" * 24, "?" * 32, "?" * 40, "$" * 32, "$" * 40, "????-????-????-????", "@@@@@@@@@@@@@@@@@@@@", "sk_@@@@_????????????????", "????????????=="],
    ),
    ("secret", False): (
        ["token = ", "password: ", "api_key=", "secret: ", "access_key = ", "PASSWORD="],
        ["changeme", "your_token_here", "xxxxxxxxxxxx", "xxxxxxxxxxxxxxxxxxxxxxxx", "placeholder_value", "required_field", "/path/to/token/file", "aaaaaaaaaaaaaaaa", "longhorn", "password-is-required", "not_set_in_this_environment", "config/secrets/production", "00000000", "12345678"],
    ),
}
#: Made spans for each text that they are cut from.
EACH = 12
_TAILS = [" ", ". ", ", ", ") ", "\n"]


def _features(c: Column) -> list[Column]:
    m, before = c["m"], F.lower(c["before"])
    digits, letters = F.length(_digits(m)), F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    out = [c["kind"] == k for k in KINDS]
    out += [F.char_length(m), digits, letters, F.char_length(m) - digits - letters, F.regexp_count(m, F.lit(r"[^0-9A-Za-z]+")), F.regexp_count(m, F.lit(r"\."))]
    out += [m.startswith("+"), m.startswith("("), m.contains("@"), before.rlike(r"[\p{L}0-9]$"), c["after"].rlike(r"^[\p{L}0-9]")]
    out += [before.rlike("tel|phone|call|fax|mobile"), before.rlike("card|visa|iban|account"), before.rlike("mail|contact|token|secret|passw|key"), before.rlike(_COUNTED)]
    out += [F.regexp_count(m, F.lit("[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]")), F.regexp_count(F.lower(m), F.lit("[aeiou]")), F.least(digits, letters)]
    assert len(out) == FEATURES
    return [x.cast("double") for x in out]


def _evidence(c: Column) -> Column:
    """Of a candidate in a text as it is, outside the base spans: false for numbers that are surely not to call, for cards and ips that fail the rules, else null."""
    m, before, n = c["m"], F.lower(c["before"]), F.length(_digits(c["m"]))
    phone = F.when(~n.between(9, 15) | m.rlike(_DATED) | before.rlike(_COUNTED), False)
    return F.when(c["kind"] == "phone", phone).when(c["kind"].isin("card", "ip"), False)


def _pick(values: list[str], h: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(h, F.lit(len(values))).cast("int"))


def injected(docs: DataFrame, each: int = EACH, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text, kind, truth, start, end): for each document `each` short texts, cut from two places of its own, between which a made span stands, personal data or its like, after words that may come before it. What is made depends on the id alone."""
    r = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("_k"))
    hash_ = lambda i: F.xxhash64("id", "_k", F.lit(i))
    kinds = list(MADE)
    which = F.pmod(F.col("_k"), F.lit(len(kinds)))
    choose = lambda f: F.coalesce(*(F.when(which == i, f(k)) for i, k in enumerate(kinds)))
    form = choose(lambda k: _pick(MADE[k][1], hash_(1)))
    digits = F.regexp_replace(F.concat(*(F.lpad(F.abs(F.pmod(hash_(i), F.lit(10**18))).cast("string"), 18, "7") for i in (2, 3, 4))), "^0", "4")
    letters = F.translate(F.concat(*(F.md5(hash_(i).cast("string")) for i in (5, 6))), "0123456789", "ghijklmnop")
    mixed = F.translate(F.concat(*(F.base64(F.unhex(F.md5(hash_(i).cast("string")))) for i in (7, 8, 9))), "+/=", "Kq8")
    hexed = F.sha2(hash_(10).cast("string"), 256)
    r = r.select("id", "_t", form.alias("_form"), digits.alias("_d"), letters.alias("_l"), mixed.alias("_m"), hexed.alias("_x"), choose(lambda k: _pick(MADE[k][0], hash_(11))).alias("_cue"), choose(lambda k: F.lit(k[0])).alias("kind"), choose(lambda k: F.lit(k[1])).alias("truth"), _pick(_TAILS, hash_(12)).alias("_tail"), F.pmod(hash_(13), F.greatest(F.char_length("_t"), F.lit(1))).cast("int").alias("_at"))
    one = lambda text, i: F.substr(text, i + 1, F.lit(1))
    put = lambda v: lambda x, i: F.when(x == "#", one(v["_d"], i)).when(x == "@", one(v["_l"], i)).when(x == "?", one(v["_m"], i)).when(x == "$", one(v["_x"], i)).otherwise(x)
    span = _once(lambda v: F.array_join(F.transform(F.split(v["_form"], ""), put(v)), ""), *map(F.col, ("_form", "_d", "_l", "_m", "_x")))
    left = F.concat(F.regexp_replace(F.substr("_t", F.col("_at") + 1, F.lit(40)), r"[^\p{L} ]", ""), F.lit(" "), F.col("_cue"))
    right = F.concat("_tail", F.regexp_replace(F.substr("_t", F.lit(1), F.lit(30)), r"[^\p{L} ]", ""))
    r = r.select("id", "kind", "truth", left.alias("_left"), span.alias("_span"), right.alias("_right"))
    return r.select("id", F.concat("_left", "_span", "_right").alias("text"), "kind", "truth", F.char_length("_left").alias("start"), (F.char_length("_left") + F.char_length("_span")).alias("end"))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `spans`: every generator's candidates. `base` says that the base rules take one; the generators' spans may overlap."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*others(docs, ("spans",)), F.concat(*(_matches(text, g) for g in GENERATORS)).alias("spans"))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


@dataclass
class Trees:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values, their weights, and the least probability to redact by kind; a kind without one adds nothing."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, features: list[Column]) -> Column:
        def value(node: object) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            at, threshold, left, right = node
            return F.when(features[at] <= F.lit(threshold), value(left)).otherwise(value(right))

        margin = sum((value(t) * F.lit(w) for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2))


def _nodes(node) -> object:
    if node.numDescendants() == 0:
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _nodes(node.leftChild()), _nodes(node.rightChild())


#: Steps of the probability at which thresholds are sought.
STEPS = 10_000


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(half, kind, base, x, label, n): every labelled candidate of all documents and of the texts made from each of them, counted by equal features; stored.

    A candidate that is a made span as a whole is labelled as that was made, one that overlaps it otherwise is negative; those that the base rules take say nothing about what
    they leave and don't count. Of candidates in the texts as they are, those that overlap a span of the base rules are positive, and dates, decimals, numbers after a word for ids,
    numbers of under 9 or over 15 digits and cards and ips that fail the rules are negative; all others have no label and are left out. Halves are chosen by a hash of the candidate.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = lambda h, label, base: [F.pmod(h, F.lit(2)).alias("half"), F.col("c.kind").alias("kind"), base.alias("base"), F.array(*_features(F.col("c"))).cast("array<int>").alias("x"), label.cast("double").alias("label")]
    own = stored(candidates(docs).select("id", "spans"), "pii-own")  # stored, so that generators run once
    own = own.withColumn("base", F.filter("spans", lambda s: s["base"])).select("id", "base", F.posexplode("spans").alias("at", "c"))
    base = F.exists("base", lambda b: _overlap(b, F.col("c")))
    own = own.select(*columns(F.xxhash64("id", "at"), F.when(base, True).otherwise(_evidence(F.col("c"))), base)).filter("label is not null")
    made = candidates(injected(docs)).withColumn("spans", F.filter("spans", lambda s: ~s["base"] & (s["start"] < F.col("end")) & (F.col("start") < s["end"])))
    made = stored(made.select("id", F.col("kind").alias("_kind"), "truth", "start", "end", "spans"), "pii-made").withColumn("c", F.explode("spans"))
    truth = F.col("truth") & (F.col("c.kind") == F.col("_kind")) & (F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end"))
    made = made.select(*columns(F.xxhash64("id", "start", "end", "c.m"), truth, F.lit(False)))
    return stored(own.unionByName(made).groupBy("half", "kind", "base", "x", "label").agg(F.count("*").alias("n")), "pii-labelled")


def thresholds(judged: DataFrame, precision: float, least: int) -> dict[str, float]:
    """Of (kind, p, label, n): for each kind the least probability, sought at STEPS steps and set halfway to the next lower one, from which on the share of positives among all n is at least `precision`, over at least `least` of them."""
    steps = judged.groupBy("kind", F.floor(F.col("p") * STEPS).alias("step")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good"), F.min("p").alias("low"), F.max("p").alias("high")).collect()  # STEPS + 1 rows a kind at most
    out = {}
    for kind in KINDS:
        mine = sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step)
        n = good = 0
        for i, r in enumerate(mine, 1):
            n, good = n + r.n, good + r.good
            if n >= least and good >= precision * n:
                out[kind] = (r.low + (mine[i].high if i < len(mine) else min(r.low, 0.5))) / 2
    return out


def fit(docs: DataFrame, trees: int = 10, depth: int = 3, precision: float = 0.98, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees trained and calibrated on the candidates of all documents.

    There are no labels of spans, so they are made: short texts are cut from every document, and in each stands a made span, personal data or what looks like it (`injected`, `labelled`).
    Candidates with the same features and label are one row that weighs their number.

    Trees are trained on each half of the candidates, by hash, and the mean of both margins counts. Each half's trees judge the other half
    to calibrate (`thresholds`), by its candidates outside the base spans, which alone can be added. Without both classes in both halves, or for kinds that never get to the precision, nothing is added.
    """
    rows = labelled(docs, id_col, text_col)
    out, judged = Trees(), []
    x = [F.col("x")[i] for i in range(FEATURES)]
    bins = max(32, math.isqrt(rows.count()) + 1)  # Spark seeks splits in a sample where there are over bins^2 rows
    for half in (0, 1):
        train, rest = rows.filter(F.col("half") == half), rows.filter(F.col("half") != half)
        if train.select("label").distinct().count() < 2:
            return Trees()
        classifier = GBTClassifier(featuresCol="v", labelCol="label", weightCol="n", maxIter=trees, maxDepth=depth, maxBins=bins, seed=7)
        model = classifier.fit(train.select(array_to_vector(F.col("x").cast("array<double>")).alias("v"), "label", "n"))
        own = Trees([_nodes(t._call_java("rootNode")) for t in model.trees], [w / 2 for w in model.treeWeights])
        out.trees += own.trees
        out.weights += own.weights
        whole = Trees(own.trees, [w * 2 for w in own.weights])
        judged.append(rest.filter(~F.col("base")).select("kind", whole.probability(x).alias("p"), "label", "n"))
    out.thresholds = thresholds(judged[0].unionByName(judged[1]), precision, least)
    return out


def find(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """docs with pii_spans, pii_base (arrays of start, rank, kind and end, in order of start, then kind) and `redacted`, the text with spans replaced by their kind in brackets.

    pii_base has what the base rules take, whatever the trees say. pii_spans has these, and of the candidates that reach their kind's
    threshold those that overlap no base span and no likelier candidate. A null text counts as empty. Whole texts are searched.
    Of equally likely candidates that overlap, the first, then the longest counts. Very long texts are searched whole; repeated rows get equal spans; an empty
    table gives an empty result. Nothing is shuffled; columns of docs with these names are replaced, others stay.
    """
    keep = others(docs, ("pii_base", "pii_spans", "redacted"))
    short = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    d = candidates(docs.select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))).alias("row"), F.col(text_col).alias("text")))
    d = d.withColumn("base", F.filter("spans", lambda s: s["base"]))
    threshold = lambda s: F.element_at(F.create_map(*(F.lit(x) for k in model.thresholds.items() for x in k)), s["kind"]) if model.thresholds else F.lit(None).cast("double")
    judged = F.transform(F.filter("spans", lambda s: ~s["base"]), lambda s: F.struct(model.probability(_features(s)).alias("p"), threshold(s).alias("t"), *(s[c].alias(c) for c in ("start", "rank", "kind", "end"))))
    chosen = F.filter(judged, lambda s: F.coalesce(s["p"] >= s["t"], F.lit(False)) & ~F.exists("base", lambda b: _overlap(b, s)))
    d = d.withColumn("more", chosen)
    better = lambda a, b: (a["p"] > b["p"]) | (a["p"] == b["p"]) & (F.struct(a["start"], -a["end"], a["rank"]) < F.struct(b["start"], -b["end"], b["rank"]))
    more = F.filter("more", lambda s: ~F.exists("more", lambda o: _overlap(o, s) & better(o, s)))
    base = F.array_sort(F.transform("base", short))
    d = d.withColumns({"pii_base": base, "pii_spans": F.array_distinct(F.array_sort(F.concat(base, F.transform(more, short))))})
    text = F.coalesce(F.col("text"), F.lit(""))

    def put(state: Column, s: Column) -> Column:
        skip = s["end"] <= state["at"]
        start = F.greatest(s["start"], state["at"])
        return F.when(skip, state).otherwise(F.struct(s["end"].alias("at"), F.concat(state["out"], F.substr(text, state["at"] + 1, start - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))

    redacted = F.aggregate("pii_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return d.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)), "pii_base", "pii_spans", redacted.alias("redacted"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
