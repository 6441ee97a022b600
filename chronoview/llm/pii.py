"""Personal data: patterns of four kinds, and what their contexts give away.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern. They are the
seeds of a bootstrap: the words that stand before a seed are a lexical pattern, other
tokens with digits or an @ that stand after the same words are instances of it. Over this graph
of patterns and instances a pattern is worth as much as its instances, and an instance as much
as its patterns; after a few rounds, patterns of high confidence, enough different seeds and
one predominant kind mark the instances that no rule had found.

Everything is column expressions: matches come from the text's pieces between them, so that
their places follow from lengths; only matches and contexts leave a row, never words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoview.llm.common import let, whole
from chronoview.session import staged

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive groups (equal here, as nothing after a group
# can match what it took) so that long runs need no stack. A run of its own characters is
# entered at its start or where the last match ended, which finds the same leftmost matches.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A word with a digit or an @.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

CONTEXT_CHARACTERS = 64
BLOCK = 256
ROUNDS = 3
# A pattern's prior of instances that are nothing; what it takes to be trusted.
PRIOR, CONFIDENCE, MIN_SEEDS, KIND_SHARE = 2.0, 0.8, 8, 0.9
FOUND = "array<struct<value:string,start:int,context:array<string>>>"


def running(lengths: Column) -> Column:
    """For each item the sum of those before it; in blocks, so that long arrays stay linear."""
    def cumulate(items: Column, base: Column) -> Column:
        start = F.struct(base.cast("int").alias("at"),
                         F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda s, x: F.struct(
            (s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"])

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda s, x: s + x)

    last = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last),
                         lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    return let(blocks, lambda parts: let(
        cumulate(F.transform(parts, total), F.lit(0)),
        lambda bases: F.flatten(F.transform(
            parts, lambda part, b: cumulate(part, F.get(bases, b))))))


def context_of(gap: Column) -> Column:
    """The last word, and the last two, of what stands before a match; digits count alike."""
    tail = F.lower(F.substring(gap, -CONTEXT_CHARACTERS, CONTEXT_CHARACTERS))
    words = F.filter(F.split(F.regexp_replace(tail, "[0-9]", "0"), r"[\x20\x09-\x0D]+"),
                     lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>"))
               .when(F.size(w) == 1, F.slice(w, -1, 1))
               .otherwise(F.array(F.element_at(w, -1),
                                  F.concat(F.element_at(w, -2), F.lit(" "),
                                           F.element_at(w, -1)))))


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """Leftmost matches that do not overlap: value, start in code points, context."""
    def placed(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(
            running(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))),
            lambda before: F.transform(found, lambda m, i: F.struct(
                m.alias("value"), (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"),
                context_of(F.get(gaps, i)).alias("context")))))

    nothing = F.array().cast(FOUND)
    found = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>"))
    return let(found, lambda m: F.when(F.size(m) == 0, nothing).otherwise(placed(m)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """What a match must fulfil besides its pattern."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."),
                        lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = digits_of(value)
        return F.when(F.length(digits).between(12, 19), passes_luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    return F.lit(True)


def may_hold(kind: str, text: Column) -> Column:
    """A cheap look whether a text can have the kind at all."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][\\x20-]?[0-9]")


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, one array of base matches per kind, and the tokens that may be more."""
    text = F.col("_text")

    def valid(kind: str, pattern: str) -> Column:
        return F.filter(matches(text, pattern, may_hold(kind, text)),
                        lambda m: holds(kind, m["value"])).alias(kind)
    base = [valid(kind, pattern) for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE))]
    tokens = matches(text, TOKEN, text.rlike("[0-9@]")).alias("tokens")
    return docs.select("doc_id", whole().alias("_text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *base, tokens)


def spans_of(kind: str) -> Column:
    number = KINDS.index(kind)
    return F.transform(kind, lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind"),
        (m["start"] + F.length(m["value"])).alias("end")))


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(found: DataFrame) -> DataFrame:
    """row, context, value, start of tokens that look like identifiers, without their quotes."""
    token = found.select("row", F.explode("tokens").alias("_token")).select("row", "_token.*")
    lead = F.length(F.regexp_extract("value", r"^[(\[<{\"'«]*", 0))
    value = F.regexp_replace(F.regexp_replace("value", r"^[(\[<{\"'«]+", ""),
                             r"[)\]>}\"'».,;:!?]+$", "")
    trimmed = token.select("row", "context", (F.col("start") + lead).alias("start"),
                           value.alias("value"))
    return trimmed.where((F.length(digits_of(F.col("value"))) >= 4) |
                         F.contains("value", F.lit("@")))


def looks_like(kind: Column, value: Column) -> Column:
    """Whether an instance has the shape that its pattern's kind asks for."""
    digits = F.length(digits_of(value))
    return (F.when(kind == 0, F.contains(value, F.lit("@")))
            .when(kind == 1, value.rlike(r"^[0-9a-fA-F.:]+$"))
            .when(kind == 2, digits.between(8, 19) & value.rlike("^[0-9-]+$"))
            .otherwise(digits.between(7, 15) & value.rlike("^[0-9().+/-]+$")))


def pattern_graph(found: DataFrame, instances: DataFrame) -> DataFrame:
    """pattern, value, kind (null for an instance that is no seed): one row per edge."""
    seeds = None
    for number, kind in enumerate(KINDS):
        own = found.select(F.explode(kind).alias("_seed")).select(
            "_seed.context", F.lower("_seed.value").alias("value"), F.lit(number).alias("kind"))
        seeds = own if seeds is None else seeds.unionByName(own)
    others = instances.select("context", F.lower("value").alias("value"),
                              F.lit(None).cast("int").alias("kind"))
    edges = seeds.unionByName(others).select(F.explode("context").alias("pattern"), "value",
                                             "kind")
    return edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern and the kind it stands for, of patterns that earned enough confidence."""
    worth = staged(edges.groupBy("value").agg(
        F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("worth")), "pii-worth")
    for k in range(rounds):
        scores = staged(edges.join(worth, "value").groupBy("pattern").agg(
            (F.sum("worth") / (F.count("*") + PRIOR)).alias("confidence")), "pii-patterns")
        if k + 1 < rounds:
            doubt = F.sum(F.log(1.0 - F.col("confidence")))
            by_pattern = edges.join(scores, "pattern").groupBy("value").agg(
                F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("_seed"),
                (1.0 - F.exp(doubt)).alias("_worth"))
            worth = staged(by_pattern.select("value", F.greatest("_seed", "_worth").alias("worth")),
                           "pii-worth")
    kinds = edges.where(F.col("kind").isNotNull()).groupBy("pattern").agg(
        *(F.sum((F.col("kind") == n).cast("long")).alias(f"_{n}") for n in range(len(KINDS))))
    counts = [F.col(f"_{n}") for n in range(len(KINDS))]
    best = F.greatest(*counts)
    number = F.coalesce(*(F.when(c == best, F.lit(n)) for n, c in enumerate(counts)))
    ruled = kinds.select("pattern", number.alias("kind"), best.alias("_best"),
                         sum(counts[1:], counts[0]).alias("_all"))
    return ruled.join(scores, "pattern").where(
        (F.col("confidence") >= CONFIDENCE) & (F.col("_all") >= MIN_SEEDS) &
        (F.col("_best") >= F.col("_all") * KIND_SHARE)).select("pattern", "kind")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found of every document.

    Counts and hash are those of the base; ``spans`` also has the n_found spans the bootstrap
    adds, none of which overlaps one of the base. A null text counts as empty; repeated rows
    are searched alike, and tokens with a null id as well; an empty table gives no rows; other
    columns are ignored.
    """
    found = staged(scanned(docs), "pii-found")
    instances = staged(candidates(found), "pii-instances")
    edges = staged(pattern_graph(found, instances), "pii-edges")
    patterns = staged(trusted_patterns(edges), "pii-trusted")
    discovered = (instances.select("row", "start", "value", F.explode("context").alias("pattern"))
                  .join(patterns, "pattern").where(looks_like(F.col("kind"), F.col("value")))
                  .groupBy("row", "start", "value").agg(F.min("kind").alias("kind"))
                  .groupBy("row").agg(F.collect_list(F.struct(
                      F.col("start"), F.col("kind"),
                      (F.col("start") + F.length("value")).alias("end"))).alias("_more")))
    base = found.select("row", "doc_id", F.concat(*map(spans_of, KINDS)).alias("_base"))
    joined = base.join(discovered, "row", "left")

    def apart(span: Column) -> Column:
        return ~F.exists("_base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    more = F.coalesce(F.filter("_more", apart), F.array().cast(
        "array<struct<start:int,kind:int,end:int>>"))
    whole_rows = joined.select("doc_id", "_base", more.alias("_more"))

    def count(number: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == number)).cast("long")
    return whole_rows.select(
        "doc_id", *(count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.concat("_base", "_more")).alias("spans"),
        F.size("_more").cast("long").alias("n_found"))
