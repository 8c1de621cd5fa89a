"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the e-mail and IP addresses, card and phone numbers that exact patterns find. The two
words before a seed induce a lexical pattern for its kind. Patterns and instances (values found
after them) form a graph: a pattern's confidence is the summed score of the instances it found over
all occurrences of its words in all documents, and an instance's score is the chance
that one of its patterns is right; both are computed in turn. Patterns of high confidence and
enough seeds then mark values of a like shape that no exact pattern finds: words, or runs of digit
groups joined by single spaces.

The exact patterns are written so that no text makes them slow: a run of characters is tried once,
and nothing is matched by recursion. Positions come from splitting a text at its matches. What is
summed along the matches of one text (positions, the words before, how far spans reach) is summed
in blocks, so a text that is nothing but addresses costs little more than its length.

A pattern must have found ``LEAST_SEEDS`` different seeds, and is trusted where the lower bound of its
confidence, for as many occurrences as its words have, reaches ``LEAST_CONFIDENCE``; neither depends on
how large the corpus is, so more documents don't hide a pattern that fewer show. How often words occur
is counted for all pairs of words of all documents, by a 64-bit hash, combined before the shuffle, and
only the counts meet the patterns; nothing is broadcast. A context is two words of at most ``CONTEXT``
characters together; a value after longer ones has none.

Defined results: null counts as an empty text; spans are in code points, ends exclusive; a match
that fails its check is dropped; repeated rows get equal results; an empty table gives no rows;
extra columns are not read, and ``redact`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import cut, saved

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
_TAIL = r"(?=[.,;:!?)\"'>\]]*+(?:\s|\z))"
#: Words that may be identifiers: seven digits, an at sign, plain or spelt, or four short numbers.
CANDIDATE = rf"(?<!\S)(?:(?=(?:[^\s0-9]*+[0-9]){{7}})|(?=[^\s@]*+@)|(?=[^\s(\[]*+[(\[]at[)\]])|(?=[(\"'<\[]*+[0-9]{{1,3}}(?:[.:][0-9]{{1,3}}){{3}}{_TAIL}))\S++"
_UNIT = r"(?:\([0-9]{1,5}+\)(?=[ .-]?+[0-9])|\[[0-9]{1,5}+\](?=[ .-]?+[0-9])|[0-9]++)"
_GROUPS = rf"{_UNIT}(?:[.-]?+{_UNIT})*+{_TAIL}"
#: Two or more words of digit groups, joined by single spaces, that have seven digits together and may be one identifier.
GROUPED = rf"(?<!\S)[(\"'<\[]*?\+?(?=[(\[]?[0-9](?:[ .()\[\]-]{{0,3}}+[0-9]){{6}}){_GROUPS}(?: {_GROUPS})++"
#: Shapes that a value of a kind may have where a pattern vouches for it.
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+(@|\(at\)|\[at\])[A-Za-z0-9-]+",
    "ip": r"^[0-9]{1,3}([.:][0-9]{1,3}){3}$",
    "card": r"^(?=(?:[^0-9]*+[0-9]){7})[0-9][0-9 -]{12,22}$",
    "phone": r"^(?=(?:[^0-9]*+[0-9]){7})[+(\[]{0,2}[0-9][0-9 ().\[\]-]{6,18}$",
}
#: The longest context, with the space around its words.
CONTEXT = 80
ROUNDS, LEAST_SEEDS, LEAST_CONFIDENCE = 3, 3, 0.5
#: Standard errors that a confidence's lower bound lies below it.
ERRORS = 1.0
#: Items of an array that are gone through one by one; longer arrays are cut into blocks of so many.
BLOCK = 256
_END = 2147483647


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def blocks_of(xs: Column) -> Column:
    """An array as an array of blocks."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))


def scanned(xs: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: Column, kind: str) -> Column:
    """For each item of an array, what ``combine`` makes of the values of all items before it.

    An array that grows item by item is copied each time, so this goes block by block: first what
    each block makes, then what all blocks before it make, then the items of each block.
    """

    def along(part: Column, first: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(first.cast(kind).alias("acc"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, start, lambda s, x: F.struct(combine(s["acc"], of(x)).cast(kind).alias("acc"), F.concat(s["out"], F.array(s["acc"])).alias("out")), lambda s: s["out"])

    def whole(part: Column) -> Column:
        return F.aggregate(part, zero.cast(kind), lambda s, x: combine(s, value(x)).cast(kind))

    return bound(blocks_of(xs), lambda bs: F.flatten(F.zip_with(bs, along(F.transform(bs, whole), zero, lambda x: x), lambda b, first: along(b, first, value))))


def located(matches: Column, parts: Column) -> Column:
    """Array of (start, end, value, before) of a text's matches, from the matches and the parts between them; ``before``: the characters before the match."""

    def spans(z: Column) -> Column:
        sizes = scanned(z, lambda x: F.char_length(x["p"]) + F.char_length(x["m"]), lambda a, b: a + b, F.lit(0), "int")
        tails = scanned(z, lambda x: F.concat(F.substring(x["p"], -CONTEXT, CONTEXT), F.substring(x["m"], -CONTEXT, CONTEXT)), lambda a, b: F.substring(F.concat(a, b), -CONTEXT, CONTEXT), F.lit(""), "string")
        placed = F.zip_with(z, F.zip_with(sizes, tails, lambda a, b: F.struct(a.alias("at"), b.alias("tail"))), lambda x, y: F.struct((y["at"] + F.char_length(x["p"])).alias("start"), x["m"].alias("value"), F.substring(F.concat(y["tail"], x["p"]), -CONTEXT, CONTEXT).alias("before")))
        return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["value"])).cast("int").alias("end"), x["value"].alias("value"), x["before"].alias("before")))

    return bound(F.zip_with(matches, F.slice(parts, 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("p"))), spans)


def apart(spots: Column, base: Column) -> Column:
    """The spots (start, end, value, context) that overlap no base span. Both are put in one order, along which base spans reach forward and backward."""
    last = F.lit(_END)
    one = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("spot"), b["end"].alias("end"), F.lit("").alias("value"), F.lit("").alias("context")))
    two = F.transform(spots, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("spot"), s["end"].alias("end"), s["value"].alias("value"), s["context"].alias("context")))

    def free(every: Column) -> Column:
        reach = scanned(every, lambda x: F.when(x["spot"] == 0, x["end"]).otherwise(0), lambda a, b: F.greatest(a, b), F.lit(0), "int")
        begin = F.reverse(scanned(F.reverse(every), lambda x: F.when(x["spot"] == 0, x["start"]).otherwise(last), lambda a, b: F.least(a, b), last, "int"))
        around = F.zip_with(every, F.zip_with(reach, begin, lambda a, b: F.struct(a.alias("reach"), b.alias("begin"))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        kept = F.filter(around, lambda z: (z["x"]["spot"] == 1) & (z["y"]["reach"] <= z["x"]["start"]) & (z["y"]["begin"] >= z["x"]["end"]))
        return F.transform(kept, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["x"]["value"].alias("value"), z["x"]["context"].alias("context")))

    return F.when(F.size(base) == 0, spots).otherwise(bound(F.array_sort(F.concat(one, two)), free))


def outermost(spans: Column) -> Column:
    """Of the different spans (start, kind, end) those not inside another of their kind."""
    key = lambda x: x["kind"].cast("long") * (1 << 32) + x["end"]

    def free(every: Column) -> Column:
        reach = scanned(every, key, lambda a, b: F.greatest(a, b), F.lit(-1), "long")
        kept = F.filter(F.zip_with(every, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), lambda z: z["r"] < key(z["x"]))
        return F.transform(kept, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["kind"].alias("kind"), z["x"]["end"].alias("end")))

    return bound(F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end")))), free)


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span (start, kind, end; in order) replaced by its kind's name in brackets; overlapping spans are one, named for the first."""
    name = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def write(part: Column, rest: Column, at: Column) -> Column:
        start = F.struct(rest.alias("rest"), at.cast("int").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            new = F.array(F.substring(s["rest"], x["from"] - s["at"] + 1, x["to"] - x["from"]), F.element_at(name, x["kind"] + 1))
            return F.struct(F.substring(s["rest"], x["to"] - s["at"] + 1, F.lit(_END)).alias("rest"), x["to"].alias("at"), F.concat(s["out"], new).alias("out"))

        return F.aggregate(part, start, step, lambda s: F.array_join(s["out"], ""))

    def segments(bs: Column) -> Column:
        """The text from each block's first piece on, to the next block's."""
        start = F.struct(text.alias("rest"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        until = F.transform(bs, lambda b: F.struct(b[0]["from"].alias("from"), b[F.size(b) - 1]["to"].alias("to")))

        def step(s: Column, x: Column) -> Column:
            rest = F.substring(s["rest"], x["from"] - s["at"] + 1, F.lit(_END))
            return F.struct(rest.alias("rest"), x["from"].alias("at"), F.concat(s["out"], F.array(F.substring(rest, F.lit(1), x["to"] - x["from"]))).alias("out"))

        return F.aggregate(until, start, step, lambda s: s["out"])

    def pieces(xs: Column) -> Column:
        reach = scanned(xs, lambda x: x["end"], lambda a, b: F.greatest(a, b), F.lit(0), "int")
        every = F.zip_with(xs, reach, lambda x, r: F.struct(r.alias("from"), x["start"].alias("to"), x["kind"].alias("kind")))
        return F.filter(every, lambda x: x["to"] >= x["from"])

    def joined(bs: Column) -> Column:
        return F.array_join(F.zip_with(bs, segments(bs), lambda b, seg: write(b, seg, b[0]["from"])), "")

    last = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
    return F.concat(bound(bound(spans, pieces), lambda ps: bound(blocks_of(ps), joined)), F.substring(text, last + 1, F.lit(_END)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's check."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) < 3) | (F.char_length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255"))
    if kind == "card":
        return F.char_length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _words_before(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, r"(?:^|\s)(\S++\s++\S++)\s*+$", 1))


def _as_span(number: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), _words_before(s["before"]).alias("context"))


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: ``id``, ``h`` (a hash of the text), ``base``: spans (start, kind number, end, value, context); ``other``: possible values (start, end, value, context) apart from them."""
    none = F.array().cast("array<string>")
    page = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    matched = {k: F.regexp_extract_all("t", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    matched = {k: F.when(F.contains("t", F.lit(NEEDS[k])), m).otherwise(none) if k in NEEDS else m for k, m in matched.items()}
    possible = {"other": CANDIDATE, "grouped": GROUPED}
    matched |= {k: F.regexp_extract_all("t", F.lit(p), F.lit(0)) for k, p in possible.items()}
    page = page.select("id", "t", *(m.alias(f"m_{k}") for k, m in matched.items()))
    spots = {k: F.when(F.size(f"m_{k}") > 0, located(F.col(f"m_{k}"), F.split("t", p, -1))) for k, p in (PATTERNS | possible).items()}
    page = page.select("id", "t", *(s.alias(f"s_{k}") for k, s in spots.items()))
    spans = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,context:string>>")
    empty = spans
    for n, k in enumerate(KINDS):
        good = F.filter(F.col(f"s_{k}"), _check(k))
        spans = F.concat(spans, F.coalesce(F.transform(good, _as_span(n)), empty))
    no_spots = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    page = page.select("id", "t", F.array_sort(spans).alias("base"), F.concat(F.coalesce("s_other", no_spots), F.coalesce("s_grouped", no_spots)).alias("spots"))
    head = lambda v: F.char_length(F.regexp_extract(v, r"^[(\"'<\[]*?(?=\([0-9]{1,5}+\)[ .-]?+[0-9]|\[[0-9]{1,5}+\][ .-]?+[0-9]|[^(\"'<\[])", 0))
    tail = lambda v: F.char_length(F.regexp_extract(v, r"[.,;:!?)\"'>\]]++$", 0))
    trimmed = lambda s: bound(F.struct(head(s["value"]).alias("head"), tail(s["value"]).alias("tail")), lambda c: F.struct((s["start"] + c["head"]).alias("start"), (s["end"] - c["tail"]).alias("end"), F.substring(s["value"], c["head"] + 1, F.greatest(F.lit(0), F.char_length(s["value"]) - c["head"] - c["tail"])).alias("value"), _words_before(s["before"]).alias("context")))
    free = bound(F.filter(F.transform("spots", trimmed), lambda s: s["start"] < s["end"]), lambda xs: apart(xs, F.col("base")))
    other = F.when(F.size("spots") > 0, free).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,context:string>>"))
    return page.select("id", F.xxhash64("t", F.char_length("t")).alias("h"), "base", other.alias("other"))


def _edges(rows: DataFrame) -> DataFrame:
    """(kind, context, value, seed, n): how often each value of a kind is found after each context."""
    base = rows.select(F.explode("base").alias("s")).select(F.col("s.kind").alias("kind"), F.col("s.context").alias("context"), F.lower("s.value").alias("value"), F.lit(True).alias("seed"))
    other = rows.select(F.explode("other").alias("s"))
    kinds = F.array_compact(F.array(*(F.when(F.col("s.value").rlike(p), F.lit(KINDS.index(k))) for k, p in SHAPES.items())))
    other = other.select(F.explode(kinds).alias("kind"), F.col("s.context").alias("context"), F.lower("s.value").alias("value"), F.lit(False).alias("seed"))
    return base.union(other).where("context != ''").groupBy("kind", "context", "value", "seed").agg(F.count("*").alias("n"))


def trusted_patterns(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(kind, context) of the patterns of high confidence; ``rows`` are those of ``found``, saved."""
    edges = cut(_edges(rows))
    pattern = ["kind", "context"]
    seeds = edges.where("seed").groupBy(*pattern).agg(F.count("*").alias("seeds"))
    able = cut(seeds.where(F.col("seeds") >= LEAST_SEEDS))
    if able.isEmpty():
        return able.select(*pattern)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != "")
    pairs = docs.select(words.alias("w")).select(F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - 1)), F.slice("w", 2, F.greatest(F.lit(0), F.size("w") - 1)), lambda a, b: F.concat_ws(" ", a, b))).alias("context"))
    plain = F.regexp_replace("context", r"\s+", " ")
    counted = pairs.groupBy(F.xxhash64("context").alias("h")).agg(F.count("*").alias("times"))  # combined before they are shuffled
    times = cut(able.select("context", F.xxhash64(plain).alias("h")).distinct().join(counted, "h").select("context", "times"))
    graph = cut(edges.join(able, pattern).select("kind", "context", "value", "seed", "n"))
    scores = cut(graph.select("kind", "value", "seed").distinct().select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score")))
    for _ in range(rounds):
        mass = graph.join(scores, ["kind", "value"]).groupBy(*pattern).agg(F.sum(F.col("score") * F.col("n")).alias("mass"))
        confidence = cut(mass.join(times, "context").select("kind", "context", F.greatest("mass", F.col("times").cast("double")).alias("n"), (F.col("mass") / F.greatest("mass", "times")).alias("confidence")))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        scores = cut(graph.join(confidence, pattern).groupBy("kind", "value").agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("score")))
    p, n, z = F.col("confidence"), F.col("n"), ERRORS
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)  # Wilson's
    return cut(confidence.where(bound >= LEAST_CONFIDENCE).select("kind", "context"))


def _text(spans: Column) -> Column:
    """Spans as kind:start:end, by start and kind, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: ``id``, ``h``, ``base`` and ``added``, arrays of spans (start, kind number, end)."""
    rows = saved(found(docs, id_col, text_col))
    patterns = trusted_patterns(rows.where("size(base) > 0 or size(other) > 0"), docs, id_col, text_col)
    spot = rows.where("size(other) > 0").select("id", "h", F.explode("other").alias("s"))
    shaped = F.coalesce(*(F.when((F.col("kind") == KINDS.index(k)) & F.col("s.value").rlike(p), True) for k, p in SHAPES.items()), F.lit(False))
    hits = spot.join(patterns, F.col("s.context") == F.col("context")).where(shaped)
    hits = hits.select("id", "h", F.struct(F.col("s.start").alias("start"), F.col("kind").alias("kind"), F.col("s.end").alias("end")).alias("s"))
    more = hits.groupBy(F.col("id").alias("i"), F.col("h").alias("hh")).agg(F.collect_set("s").alias("added"))
    more = cut(more.select("i", "hh", outermost(F.col("added")).alias("added")))  # a word of a run that is one itself goes; a join right after the aggregation could not be split by key
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = rows.select("id", "h", base.alias("base"))
    joined = rows.join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh")), "left")
    return joined.select("id", "h", "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


def summary(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of every row of ``personal_data``: its id, base counts by kind, ``base_sha256`` and all ``spans``."""
    counts = [F.size(F.filter("base", _of_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return spans.select(F.col("id").alias(id_col), *counts, F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by the kind's name in brackets; overlapping spans are one, named for the first."""
    spans = personal_data(docs, id_col, text_col)
    touched = spans.where("size(base) > 0 or size(added) > 0").select(F.col("id").alias("_i"), F.col("h").alias("_h"), F.array_sort(F.concat("base", "added")).alias("_s")).distinct()
    t = F.col("_row")[text_col]
    whole = F.coalesce(t, F.lit(""))
    able = F.coalesce(F.col(text_col).rlike(r"[0-9@\[(]"), F.lit(False))  # others can have no span, and needn't be joined
    part = docs.where(able).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))  # so no column of the table clashes with those of the spans
    same = F.col("_row")[id_col].eqNullSafe(F.col("_i")) & (F.xxhash64(whole, F.char_length(whole)) == F.col("_h"))
    out = part.join(touched, same, "left")
    clean = F.when(F.col("_s").isNotNull(), replaced(t, F.col("_s"))).otherwise(t)
    out = out.select(*(clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
    return out.union(docs.where(~able))
