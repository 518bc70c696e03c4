"""Personal data: fixed patterns, and boosted trees over wider candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quality import let
from .text import computed, find_spans, running, text_of, without
from .trees import Trees, fit_trees, in_hash_order, tree_score

#: The contract's patterns, written for Java so that no text makes them backtrack or recurse far. A match starts
#: where its run of characters starts (or the last match ended): a start inside a run fails when the run's start does.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns whose candidates the trees judge; they overlap each other and the base kinds. Runs are possessive and have no greatest length; :func:`_possible` checks a match afterwards.
CANDIDATES = {
    "address": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:\[at\]|\(at\)|\{at\}|@)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\.|\x20dot\x20)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "number": r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().:/-]{0,2}[0-9])++(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4})++(?:\x20?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4})++(?![0-9A-Za-z:])",
}
KINDS = (*BASE, *CANDIDATES)
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: What stands in front: kinds of words that personal numbers follow, and of words and signs that other numbers follow.
CONTEXTS = (r"(?i)(phone|tel|call|fax|mobile|cell)\W*$", r"(?i)(card|visa|account|iban|pay\w*)\W*$", r"(?i)(mail|contact|write|reach|host|address|from|server)\W*$", r"""["'=:]\x20?$""", r"[A-Za-z]\x20$")
HARMLESS = r"(?i)(?:\b(?:version|release|order|invoice|ticket|case|page|isbn|issue|item|part|model|serial|batch|sku|ref|reference|no|nr)\b|[#$€£])\W*(?:(?:no|nr|number|id)\b\W*)?$"
#: Formats of numbers that are dates, times, decimals or groups of thousands.
PLAIN = r"^(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?:[\x20T][0-9:.]*)?|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}|[0-9]+\.[0-9]+|[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)$"
FEATURES = 14
RECALL = 0.98  # share of held-out sure candidates that the threshold keeps


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value), F.lit(0), lambda acc, d: acc + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    return {"email": F.lit(True), "ip": value.rlike(OCTETS), "phone": n.between(8, 15),
            "card": F.when(n.between(16, 19), luhn(_digits(value))).otherwise(False)}[kind]


def iban_check(value: Column) -> Column:
    """Whether letters as numbers, the first four characters last, leave 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda rest, c: F.when(
        c.rlike("[0-9]"), (rest * 10 + c.try_cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)) == 1


def _possible(kind: str, value: Column) -> Column:
    """Whether a match may be of its kind at all, by its length and parts."""
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    return {
        "address": F.lit(True), "number": F.char_length(_digits(value)).between(7, 30),
        "iban": F.char_length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34),
        "ipv6": value.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (
            value.rlike(r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$") & groups.between(2, 7))}[kind]


def _label(kind: str, c: Column) -> Column:
    """1 for what passes a check of its own, 0 for what fails one or stands in a harmless context, null for what nothing is known of."""
    v, n = c["value"], F.char_length(_digits(c["value"]))
    own = {"address": F.lit(None).cast("int"), "ipv6": F.lit(1), "iban": iban_check(v).cast("int"),
           "number": F.when(v.rlike(PLAIN) | (n.between(16, 19) & ~luhn(_digits(v))), F.lit(0))}[kind]
    return own if kind in ("ipv6", "address") else F.when(c["before"].rlike(HARMLESS), F.lit(0)).otherwise(own)


def _features(v: Column, before: Column) -> Column:
    """Format and context of a candidate as doubles. What defines a base match (a plus, a checksum) or its generator is left out."""
    n = F.greatest(F.char_length(v), F.lit(1))
    digits = F.char_length(_digits(v))
    letters = F.char_length(F.regexp_replace(v, "[^A-Za-z]", ""))
    parts = F.split(v, "[^0-9A-Za-z]+")
    longest = F.array_max(F.transform(parts, lambda x: F.char_length(x)))
    values = [digits / n, letters / n, (n - digits - letters) / n, F.size(parts), longest, F.least(digits, F.lit(40)), v.rlike(r"[0-9]{7}"), v.rlike("[A-Za-z]{2}"),
              before.rlike(HARMLESS), *[before.rlike(k) for k in CONTEXTS]]
    return F.array(*[x.cast("double") for x in values])


def candidates(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds ``base`` (kind, start, end of valid base spans, by kind as listed, then start) and ``_llm_candidates``.

    A narrow pass. Each candidate carries its features, whether it overlaps a base span (``covered``), and its label: 1 if
    it is sure to be personal (covered, or a check of its own is passed), 0 if sure not to be, else null.
    """
    held = without(docs, "base", "spans").withColumn("_llm_text", text_of(text_column))
    found = find_spans(held, {f"_llm_s_{k}": p for k, p in {**BASE, **CANDIDATES}.items()}, "_llm_text")

    def kept(kind: str) -> Column:
        return F.transform(F.filter(f"_llm_s_{kind}", lambda s: _valid(kind, s["value"])),
                           lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def described(kind: str) -> Column:
        return F.transform(F.filter(f"_llm_s_{kind}", lambda s: _possible(kind, s["value"])), lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _features(s["value"], s["before"]).alias("x"), local(kind, s).alias("y"), _label(kind, s).alias("own")))

    def local(kind: str, s: Column) -> Column:
        """A number without its first group, as it is written at home; it stands for the number itself if that is a phone's."""
        if kind != "number":
            return F.lit(None).cast("array<double>")
        home = F.regexp_replace(s["value"], r"^\(?[0-9]{1,3}\)?[\x20.-]+", "")
        return F.when((home != s["value"]) & F.char_length(_digits(home)).between(7, 12), _features(home, s["before"]))

    both = computed(found, {"base": F.concat(*[kept(k) for k in BASE]), "_llm_wide": F.concat(*[described(k) for k in CANDIDATES])})
    # in order of a base span's start or a candidate's last position, all base spans that can overlap a candidate come before it
    events = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("key"), F.lit(0).alias("late"), s["end"].alias("end"), F.lit(-1).alias("i"))),
        F.transform("_llm_wide", lambda s, i: F.struct((s["end"] - 1).alias("key"), F.lit(1).alias("late"), F.lit(-1).cast("bigint").alias("end"), i.alias("i")))))

    def reached(e: Column) -> Column:
        reach = running(F.transform(e, lambda x: x["end"]), -1, lambda a, b: F.greatest(a, b))
        return F.filter(F.transform(F.arrays_zip(e.alias("e"), reach.alias("reach")), lambda z: F.struct(z["e"]["i"].alias("i"), z["reach"].alias("reach"))), lambda z: z["i"] >= 0)

    marked = let(events, reached)
    return both.withColumn("_llm_candidates", F.when(F.size("_llm_wide") == 0, F.array().cast(CANDIDATE)).otherwise(
        F.transform(marked, lambda m: let(F.get(F.col("_llm_wide"), m["i"]), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["x"].alias("x"), s["y"].alias("y"), (m["reach"] > s["start"]).alias("covered"),
            F.when(m["reach"] > s["start"], F.lit(1)).otherwise(s["own"]).alias("label")))))
    ).drop("_llm_text", "_llm_wide", *[f"_llm_s_{k}" for k in KINDS])


CANDIDATE = "array<struct<kind:string,start:bigint,end:bigint,x:array<double>,y:array<double>,covered:boolean,label:int>>"


def train(prepared: DataFrame, recall: float = RECALL) -> tuple[Trees | None, float]:
    """Trees and their threshold from the corpus itself.

    Positives are candidates that are sure to be personal, negatives those that are sure not to be; what nothing is known
    of is neither. Numbers inside base spans also count without their first group, as the form in which they are
    written at home. The trees are fitted on all of them but a fifth, by hash, and the whole fifth sets the
    threshold: the score that ``recall`` of the positives reach there or, where as many negatives lie below a
    lower one, the middle between the two.
    """
    names = [f"x{i}" for i in range(FEATURES)]
    known = prepared.select(F.explode("_llm_candidates").alias("c")).where("c.label is not null")
    seen = F.array_compact(F.array(F.col("c.x"), F.when(F.col("c.covered"), F.col("c.y"))))  # a phone's number counts with and without its first group
    rows = known.select(F.col("c.label").cast("double").alias("label"), F.xxhash64("c").alias("key"), F.explode(seen).alias("x")).select(
        "label", "key", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    chosen = in_hash_order(cut_lineage(rows), F.col("key")).withColumn("fold", F.col("key") % 5)
    model = fit_trees(chosen.where("fold <> 0"), names)
    if model is None:
        return None, 2.0
    row = F.array(*[F.col(n) for n in names])
    score = let(row, lambda x: tree_score(model, [x[i] for i in range(FEATURES)]))
    # cut off at six decimals, so that a percentile holds a bounded number of values
    held = chosen.where("fold = 0").select("label", (F.floor(score * 1e6) / 1e6).alias("score"))
    low = held.where("label = 1").select(F.percentile("score", 1 - recall)).first()[0]
    high = held.where("label = 0").select(F.percentile("score", recall)).first()[0]
    if low is None or high is None:
        return model, 0.5
    return model, float(low if high >= low else (low + high) / 2)


def select_spans(prepared: DataFrame, model: Trees | None, threshold: float) -> DataFrame:
    """Adds ``spans``: all base spans, then the candidates that reach ``threshold``, overlap none of them and are not known to be harmless.

    Of selected candidates that overlap one another, in a chain, the first stays. Ordered by kind as listed, then start.
    """
    if model is None:
        return prepared.withColumn("spans", F.col("base")).drop("_llm_candidates")
    score = lambda c: tree_score(model, [c["x"][i] for i in range(FEATURES)])
    good = F.array_sort(F.transform(F.filter("_llm_candidates", lambda c: ~c["covered"] & (F.coalesce(c["label"], F.lit(1)) == 1) & (score(c) >= threshold)), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))

    def first(g: Column) -> Column:
        reach = running(F.transform(g, lambda x: x["end"]), -1, lambda a, b: F.greatest(a, b))
        return F.filter(F.transform(F.arrays_zip(g.alias("g"), reach.alias("reach")), lambda z: F.when(z["reach"] <= z["g"]["start"], z["g"])), lambda g: g.isNotNull())

    out = computed(prepared, {"_llm_extra": F.when(F.size("_llm_candidates") == 0, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")).otherwise(let(good, first))})
    return out.withColumn("spans", F.concat("base", *[_of_kind(k) for k in CANDIDATES])).drop("_llm_extra", "_llm_candidates")


def _span(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _of_kind(kind: str) -> Column:
    return F.transform(F.filter("_llm_extra", lambda s: s["kind"] == kind), _span)


def find_pii(docs: DataFrame, text_column: str = "text", recall: float = RECALL) -> DataFrame:
    """Adds ``base`` and ``spans`` (arrays of kind, start, end; code points, end exclusive) to each document.

    Base kinds are pattern matches, leftmost and non-overlapping per kind, that pass their check: ip parts
    up to 255, 16 to 19 digits under the Luhn check for card, 8 to 15 digits for phone. They always stay.
    High-recall patterns propose further, overlapping candidates: spelled-out addresses, numbers of 7 to 30 digits,
    account numbers, IPv6 addresses. Boosted trees judge their format and context, and those above a calibrated
    threshold are added. The trees learn from candidates that overlap a base span or pass a check of their own
    (account numbers modulo 97, IPv6 by its grammar) against those that fail one, are dates or decimals, or
    follow words like "order" and "version"; see :func:`train`.

    Everything but the fit is a narrow pass: no shuffle and no key. A null or empty text has no spans;
    repeated rows are each scanned; without candidates of both labels only base spans are returned.
    """
    prepared = candidates(docs, text_column)
    model, threshold = train(prepared.select("_llm_candidates"), recall)
    return select_spans(prepared, model, threshold)


def redact(found: DataFrame, text_column: str = "text") -> DataFrame:
    """Replaces every span of ``spans`` in the text by its kind in brackets; of overlapping spans the first in the text stands for all.

    Costs one pass over the text per span.
    """
    def cut(s: Column) -> Column:
        """Sorted spans to a text: what lies before each uncovered start, a label, and the tail."""
        reach = running(F.transform(s, lambda x: x["end"]), 0, lambda a, b: F.greatest(a, b))
        parts = F.transform(F.arrays_zip(s.alias("s"), reach.alias("reach")), lambda z: F.when(z["s"]["start"] >= z["reach"], F.concat(
            F.substring(F.col(text_column), z["reach"].cast("int") + 1, (z["s"]["start"] - z["reach"]).cast("int")), F.lit("["), F.upper(z["s"]["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(parts, ""), F.substring(F.col(text_column), F.array_max(F.transform(s, lambda x: x["end"])).cast("int") + 1, F.lit(2**31 - 1)))

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.withColumn(text_column, F.when(F.size("spans") == 0, F.col(text_column)).otherwise(let(ordered, cut)))
