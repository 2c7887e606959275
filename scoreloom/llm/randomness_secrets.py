"""Secret scans: fixed patterns, and strings that a battery of randomness tests cannot tell from noise.

A candidate is a run of 20 or more characters of common encodings, with a letter and a digit or with an
upper-case letter after a lower-case one. Its encoding is the least alphabet that holds it (hexadecimal, base 36, 62,
64). The battery asks two things about each of its three tests, alphabet uniformity, runs and serial
dependence.

* Against noise over that alphabet: pairs of equal characters (chi-squared in other units), changes
  around the alphabet's middle, and serial correlation. The first two p-values are Chernoff bounds,
  which hold at 20 characters too. A candidate that one of them rejects is no secret.
* Against ordinary text: how much likelier the candidate is as noise than as ordinary text, whose
  alphabet (characters of a class), runs (changes between lower case, upper case, digits and marks)
  and serial dependence (which letter follows which) are counted in the distinct words of up to 19
  characters of every document. Ordinary text reaches a likelihood ratio of r with a probability of
  1 / r at most, so its inverse is a p-value, of use from 20 characters on.

These p-values pass a Benjamini-Hochberg step within each stratum of lengths, from counts by stratum
and whole bits.

Defined cases: a null text counts as empty; repeated rows and null doc_ids are scanned row by row;
with fewer than LEAST_PAIRS pairs of characters in ordinary words there is nothing to compare with
and only the fixed patterns are found; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import store
from scoreloom.llm.expressions import let, matches

#: Fixed patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MAY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Ordinary text to compare with: words of candidates' characters that are shorter than a candidate.
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{2,19}(?![A-Za-z0-9+/_-])"
#: Pairs of characters in ordinary words below which nothing is compared.
LEAST_PAIRS = 2000
#: Share of ordinary characters whose class is any, as in identifiers, whatever the class before.
ANY_CLASS = 0.1
#: A candidate is no longer held random when a test of the battery has a smaller p-value than this.
REJECT_RANDOM = 1e-4
#: The false-discovery rate within a stratum of lengths.
FALSE_DISCOVERIES = 0.01
#: Strata end before these lengths.
STRATA = (24, 32, 48, 96)
#: Bits of evidence beyond which no more are counted.
MOST_BITS = 4096
#: Characters of candidates by class: digits, upper case, lower case, marks.
CLASSES = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "+/_-")
ALPHABETS = {
    "hex": (16, "0123456789abcdef"),
    "base36": (36, "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": (62, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": (64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


def ordinary_pairs(docs: DataFrame) -> dict[str, int]:
    """How often each two characters stand together in the distinct ordinary words of all documents, a blank around each word."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    # A word is taken apart once, however many documents hold it.
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(2)))
    # At most one row for each two of 67 characters.
    return {r["pair"]: r["n"] for r in counted.select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def ordinary_bits(pairs: dict[str, int]) -> list[float] | None:
    """Bits of each character of CLASSES after a blank (first row) or another one, as ordinary text has them, row by row.

    A character's class depends on the class before; a letter, in either case, on the letter before; digits and marks on nothing.
    """
    if sum(pairs.values()) < LEAST_PAIRS:
        return None
    every = "".join(CLASSES)
    kind = {c: k for k, some in enumerate(CLASSES) for c in some} | {" ": len(CLASSES)}
    classes = [[1.0] * len(CLASSES) for _ in range(len(CLASSES) + 1)]
    letters = {a: dict.fromkeys(CLASSES[2], 0.5) for a in (*CLASSES[2], " ")}
    others = dict.fromkeys(CLASSES[0] + CLASSES[3], 1.0)
    is_letter = lambda c: kind[c] in (1, 2)
    for (a, b), n in pairs.items():
        if b == " ":
            continue
        classes[kind[a]][kind[b]] += n
        if is_letter(b):
            letters[a.lower() if is_letter(a) else " "][b.lower()] += n
        else:
            others[b] += n
    out = []
    for a in (" ", *every):
        after, row = classes[kind[a]], letters[a.lower() if is_letter(a) else " "]
        in_row = sum(row.values())
        for b in every:
            share = row[b.lower()] / in_row if is_letter(b) else others[b] / sum(others[c] for c in CLASSES[kind[b]])
            of_class = (1 - ANY_CLASS) * after[kind[b]] / sum(after) + ANY_CLASS / len(CLASSES)
            out.append(-math.log2(of_class * share))
    return out


def _same(x: Column) -> Column:
    """The sum of squared character counts of a string."""
    return F.aggregate(
        F.array_distinct(F.split(x, "")),
        F.lit(0).cast("long"),
        lambda s, c: s + F.when(c == "", F.lit(0)).otherwise(F.pow(F.length(x) - F.length(F.replace(x, c)), F.lit(2))).cast("long"),
    )


def _tail(z: Column) -> Column:
    """log10 of the standard normal's upper tail, by its logistic approximation up to 3 and its series beyond."""
    near = -F.log10(1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))
    far = -(z * z / 2) * math.log10(math.e) - F.log10(F.greatest(z, F.lit(1.0)) * math.sqrt(2 * math.pi))
    return F.when(z > 3, far).otherwise(near)


def _log(x: Column) -> Column:
    """The natural logarithm, 0 at 0, where it is multiplied by 0."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(0.0))


def _battery(token: Column, bits: list[float]) -> Column:
    """Length, the least log10 p-value against noise, and bits of evidence against ordinary text of one candidate."""
    body = F.rtrim(token, F.lit("="))
    lower = F.lower(body)
    one_case = (body == lower) | (body == F.upper(body))
    kind = (
        F.when(body.rlike("^[0-9a-f]+$") | body.rlike("^[0-9A-F]+$"), "hex")
        .when(one_case & body.rlike("^[A-Za-z0-9]+$"), "base36")
        .when(body.rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64")
    )
    every = "".join(CLASSES)
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in bits)), ",").cast("array<double>")

    def tests(k: Column) -> Column:
        text = F.when(k.isin("hex", "base36"), lower).otherwise(F.translate(body, "-_", "+/"))
        size, letters = F.lit(64.0), F.lit(ALPHABETS["base64"][1])
        for name in ("hex", "base36", "base62"):
            size = F.when(k == name, float(ALPHABETS[name][0])).otherwise(size)
            letters = F.when(k == name, ALPHABETS[name][1]).otherwise(letters)
        return let(F.struct(text.alias("text"), size.alias("size"), letters.alias("letters"), table.alias("table")), on)

    def on(h: Column) -> Column:
        n = F.length(h["text"]).cast("double")
        chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
        places = F.transform(chars(h["text"]), lambda c: (F.instr(h["letters"], c) - F.lit(0.5)) / h["size"] - 0.5)
        start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("serial"))
        step = lambda s, x: F.struct(
            x.alias("x"), (s["changes"] + F.when(s["x"] * x < 0, 1.0).otherwise(0.0)).alias("changes"), (s["serial"] + 12 * s["x"] * x).alias("serial")
        )
        first = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("bits"))
        read = lambda s, c: let(
            F.instr(F.lit(every), c), lambda p: F.struct(p.alias("at"), (s["bits"] + F.get(h["table"], s["at"] * len(every) + p - 1)).alias("bits"))
        )

        def scored(u: Column) -> Column:
            equal, expected = (_same(h["text"]) - n) / 2, n * (n - 1) / 2 / h["size"]
            q = u["noise"]["changes"] / (n - 1)
            chi = F.when(equal > expected, equal - expected - equal * _log(equal / expected)).otherwise(F.lit(0.0)) * math.log10(math.e)
            runs = -(n - 1) * (q * _log(2 * q) + (1 - q) * _log(2 * (1 - q))) * math.log10(math.e)
            serial = _tail(F.abs(u["noise"]["serial"]) / F.sqrt(n - 1))
            least = F.least(chi, runs + math.log10(2), serial + math.log10(2)) + math.log10(3)
            evidence = u["ordinary"]["bits"] - n * F.log2(h["size"])
            whole = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_BITS)), evidence))).cast("int")
            return F.struct(n.alias("n"), least.alias("log_p_random"), whole.alias("bits"))

        return let(F.struct(F.aggregate(places, start, step).alias("noise"), F.aggregate(chars(body), first, read).alias("ordinary")), scored)

    return let(kind, tests)


def scan(docs: DataFrame, bits: list[float] | None, carry: bool = False) -> DataFrame:
    """doc_id, (with carry the whole row,) base spans, and candidates that the battery holds random, by stratum and bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = "array<struct<start:bigint,end:bigint,kind:string>>"
    bare = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    assign = bare(F.filter(matches(F.col("text"), ASSIGN, "assign", (2,)), lambda x: F.length(x["g2"]) >= 6))
    access, hexes = (bare(matches(F.col("text"), p, k)) for p, k in ((ACCESS, "access"), (HEX, "hex")))
    when = lambda may, spans: F.when(F.col("text").rlike(may), spans).otherwise(F.array().cast(none))
    both = lambda x: x["text"].rlike("[A-Za-z]") & x["text"].rlike("[0-9]|[a-z][A-Z]")

    def parts(x: Column) -> Column:
        """What no base span covers of a run, in pieces that are candidates themselves."""
        over = F.filter("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        blank = lambda t, b: let(
            F.struct((F.greatest(b["start"], x["start"]) - x["start"]).cast("int").alias("at"), (F.least(b["end"], x["end"]) - x["start"]).cast("int").alias("to")),
            lambda k: F.concat(F.substring(t, F.lit(1), k["at"]), F.repeat(F.lit(" "), k["to"] - k["at"]), F.substring(t, k["to"] + 1, F.length(t))),
        )
        moved = lambda t: F.transform(
            matches(t, CANDIDATE, "random"),
            lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), y["text"].alias("text")),
        )
        whole = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
        return F.when(F.size(over) == 0, whole).otherwise(let(F.aggregate(over, x["text"], blank), moved))

    kind_of = "array<struct<start:bigint,end:bigint,stratum:int,bits:int>>"
    if bits is None:
        found = F.array().cast(kind_of)
    else:
        runs = F.flatten(F.transform(matches(F.col("text"), CANDIDATE, "random"), parts))
        tested = F.transform(
            F.filter(runs, lambda x: both(x) & (F.length(F.rtrim(x["text"], F.lit("="))) >= 20)),
            lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _battery(x["text"], bits).alias("t")),
        )
        held = F.transform(
            F.filter(tested, lambda c: c["t"]["log_p_random"] >= math.log10(REJECT_RANDOM)),
            lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _stratum(c["t"]["n"]).alias("stratum"), c["t"]["bits"].alias("bits")),
        )
        found = F.when(F.col("text").rlike(CANDIDATE), held).otherwise(F.array().cast(kind_of))
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    based = F.concat(when(ASSIGN_MAY, assign), when(ACCESS, access), when(HEX, hexes)).alias("base")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), *whole).select("*", based).select("doc_id", *(["row"] if carry else []), "base", found.alias("open"))


def _rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        out = F.when(kind == name, k).otherwise(out)
    return out


def _listed(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), _rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _stratum(n: Column) -> Column:
    return sum((F.when(n >= s, 1).otherwise(0) for s in STRATA), F.lit(0))


def discovery_limits(counts: list[tuple[int, int, int]], rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Per stratum the fewest bits that pass Benjamini-Hochberg; counts: (stratum, bits, n) of p-values 2 ** -bits."""
    limits = {}
    for stratum in {s for s, _, _ in counts}:
        own = sorted(((b, n) for s, b, n in counts if s == stratum), reverse=True)
        total, passed = sum(n for _, n in own), 0
        for bits, n in own:
            passed += n
            if -bits <= math.log2(rate * passed / total):
                limits[stratum] = bits
    return limits


def secrets(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind) for every row of docs; with carry the row too."""
    held = store(scan(docs, ordinary_bits(ordinary_pairs(docs)), carry), "secrets")
    kept = ["row"] if carry else []
    tally = held.select(F.explode("open").alias("c")).groupBy("c.stratum", "c.bits").agg(F.count(F.lit(1)).alias("n"))
    # At most MOST_BITS counts of each stratum.
    limits = discovery_limits([tuple(r) for r in tally.collect()])

    def passed(c: Column) -> Column:
        out = F.lit(False)
        for stratum, least in limits.items():
            out = out | ((c["stratum"] == stratum) & (c["bits"] >= least))
        return out

    found = F.transform(F.filter("open", passed), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("random").alias("kind")))
    return held.select("doc_id", *kept, _listed(F.col("base")).alias("base"), _listed(F.concat("base", found)).alias("spans"))


MASK = "[SECRET]"


def _masked(text: Column, spans: Column) -> Column:
    """text with every stretch of overlapping spans replaced by MASK; spans are sorted by start."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        )
        new = F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"]), joined).otherwise(new)

    def fill(m: Column) -> Column:
        before = F.transform(
            m,
            lambda x, k: F.concat(
                F.substring(text, F.coalesce(F.get(m, k - 1)["end"], F.lit(0)).cast("int") + 1, (x["start"] - F.coalesce(F.get(m, k - 1)["end"], F.lit(0))).cast("int")),
                F.lit(MASK),
            ),
        )
        return F.concat(F.concat_ws("", before), F.substring(text, F.get(m, F.size(m) - 1)["end"].cast("int") + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.aggregate(spans, F.array().cast(kind), add), fill))


def mask(docs: DataFrame) -> DataFrame:
    """docs with found secrets masked in text; an n_chars column follows the new text."""
    found = secrets(docs, carry=True)
    out = {n: F.col(f"row.{n}") for n in docs.columns}
    out["text"] = _masked(F.col("row.text"), F.col("spans"))
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("spans") == 0, out["n_chars"]).otherwise(F.length(out["text"]).cast(docs.schema["n_chars"].dataType))
    return found.select(*[c.alias(n) for n, c in out.items()])


def op5(docs: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return secrets(docs).select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
