"""Personal data: patterns of fixed form, and identifiers found by their context.

Native throughout: DataFrame and SQL functions only.

The base kinds are found by regular expressions (email, ip, card, phone) and checked by
their digits. They are the seeds of a bootstrapped extraction: the words around an entity
are its lexical patterns, tokens that look like identifiers are further instances, and the
graph of patterns and instances is scored in rounds. A pattern is trusted as far as the
instances it brings are; an instance as far as its patterns are. Unknown instances in
patterns that are trusted enough, and that enough different instances confirm, become spans
of kind ``id``. Seeds confirm a pattern, and so do instances found by others once they are
trusted enough, so a pattern needs no seed of its own. Rounds go on until no more patterns
or instances pass.

How positions are found: every match is set between marks, and the text split there, so
one pass gives the matches and what lies between them. Marks in a text are replaced by
another control character of no pattern first. Repetitions are possessive, so a long run
costs neither stack nor quadratic time.

Defined cases: a null text counts as empty and has no spans; repeated rows are treated
alike and each gives a row; null ids are kept. Equal instances count once for a pattern,
however often they occur. Further columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.base import stash

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"

ROUNDS = 3
LEAST_SEEDS = 5
TRUST = 0.8

# The base patterns, with possessive repetition where nothing can follow.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    FOUND: r"(?<![A-Za-z0-9_.@+-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+(?![@])",
}


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


_LUHN = """aggregate(sequence(1, length({d})), 0, (a, i) -> a + case
    when i % 2 = 1 then cast(substring(reverse({d}), i, 1) as int)
    when cast(substring(reverse({d}), i, 1) as int) > 4 then 2 * cast(substring(reverse({d}), i, 1) as int) - 9
    else 2 * cast(substring(reverse({d}), i, 1) as int) end) % 10 = 0"""

_VALID = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), x -> length(regexp_replace(x, '^0+', '')) <= 3 and cast(right(x, 4) as int) <= 255)",
    "card": f"length({_digits('s.value')}) between 13 and 19 and {_LUHN.format(d=_digits('s.value'))}",
    "phone": f"length({_digits('s.value')}) between 9 and 15",
    FOUND: "true",
}


# What every match of a kind holds: texts without it skip the pattern.
_NEEDS = {"email": "contains(_text, '@')", "phone": "contains(_text, '+')"}
_ANY_DIGIT = "_text rlike '[0-9]'"


def _parts(kind: str) -> Column:
    """Text between matches and matches, in turns; one entry if nothing matches."""
    marked = F.regexp_replace("_text", PATTERNS[kind], "\u0001$0\u0001")
    return F.when(F.expr(_NEEDS.get(kind, _ANY_DIGIT)), F.split(marked, "\u0001", -1)).otherwise(F.array("_text"))


def _starts(kind: str) -> Column:
    """Code points before each part, and of them all."""
    return F.expr(f"aggregate(_{kind}, array(0), (a, x) -> array_append(a, element_at(a, -1) + length(x)))")


def _spans(kind: str) -> Column:
    """kind, start, end (code points), value and the text around every valid match."""
    p, starts = f"_{kind}", f"_{kind}_starts"
    return F.expr(f"""filter(transform(
        if(size({p}) > 1, sequence(1, size({p}) - 1, 2), cast(array() as array<int>)),
        i -> struct('{kind}' as kind, cast({starts}[i] as bigint) as start, cast({starts}[i + 1] as bigint) as end,
            {p}[i] as value, right({p}[i - 1], 60) as before, left({p}[i + 1], 60) as after)), s -> {_VALID[kind]})""")


def _overlapping(spans: str, s: str) -> str:
    return f"exists({spans}, b -> b.start < {s}.end and {s}.start < b.end)"


def _scanned(documents: DataFrame) -> DataFrame:
    """Adds base (spans of the four kinds, by kind, then start) and candidates (the tokens that may be identifiers)."""
    marked = documents.withColumn("_text", F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\u0001", "\u0002"))
    for kind in (*KINDS, FOUND):
        marked = marked.withColumn(f"_{kind}", _parts(kind))
    for kind in (*KINDS, FOUND):
        marked = marked.withColumn(f"_{kind}_starts", _starts(kind))
    for kind in (*KINDS, FOUND):
        marked = marked.withColumn(f"_{kind}", _spans(kind))
    marked = marked.withColumn("base", F.concat(*(F.col(f"_{kind}") for kind in KINDS)))
    return marked.withColumn("candidates", F.expr(f"filter(_{FOUND}, s -> not {_overlapping('base', 's')})"))


def _patterns(s: str) -> str:
    """Lexical patterns of a span: the two words before it; the words on both sides. One without a letter says nothing."""
    words = f"filter(split(lower(regexp_replace({s}.before, '[0-9]', '0')), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    right = f"try_element_at(filter(split(lower(regexp_replace({s}.after, '[0-9]', '0')), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), 1)"
    return f"""filter(array(
        if(size({words}) > 1, concat('2 ', array_join(slice({words}, -2, 2), ' ')), null),
        if(size({words}) > 0, concat('1 ', element_at({words}, -1), ' _ ', {right}), null)), x -> x rlike '\\\\p{{L}}')"""


def _edges(scanned: DataFrame) -> DataFrame:
    """pattern, instance (hash of kind and value), seed: each once."""
    spans = scanned.select(F.explode(F.concat("base", "candidates")).alias("s")).select(
        F.explode(F.expr(_patterns("s"))).alias("pattern"),
        F.xxhash64("s.value").alias("instance"),
        (F.col("s.kind") != FOUND).alias("seed"),
    )
    return spans.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def trusted_patterns(
    scanned: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, trust: float = TRUST
) -> DataFrame:
    """pattern, score of the patterns worth following.

    Patterns no seed has can't gain trust before an instance of theirs has, so each round
    is two grouped sums over the edges, pre-aggregated before the shuffle. Scores and beliefs
    only grow. After ``rounds`` rounds, further ones follow as long as one brings a pattern or
    an instance over a threshold.
    """
    edges = stash(_edges(scanned), "edges")
    belief = edges.groupBy("instance").agg(F.max("seed").alias("seed")).select("instance", F.col("seed").cast("double").alias("belief"))
    done, passed, before = 0, None, None
    while done < rounds or passed != before:
        score = (
            edges.join(belief, "instance").groupBy("pattern")
            .agg(F.sum("belief").alias("sure"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("belief") >= trust).alias("seeds"))
            .select("pattern", (F.col("sure") / (F.col("n") + 1)).alias("score"), "seeds")
        )
        score = stash(score, "patterns")
        strong = score.where((F.col("seeds") >= least_seeds) & (F.col("score") >= trust / 2))
        belief = (
            edges.join(strong, "pattern", "left").groupBy("instance")
            .agg(F.max("seed").alias("seed"), F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999)))).alias("doubt"))
            .select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("belief"))
        )
        belief = stash(belief, "beliefs")
        done += 1
        if done >= rounds - 1:
            before, passed = passed, (
                *strong.agg(F.count(F.lit(1)), F.count_if(F.col("score") >= trust)).first(), belief.where(F.col("belief") >= trust).count()
            )
    return score.where((F.col("seeds") >= least_seeds) & (F.col("score") >= trust)).select("pattern", "score")


_PLAIN = "transform({0}, s -> struct(s.kind as kind, s.start as start, s.end as end))"
_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_NONE = f"cast(array() as {_SPAN})"


def _found(scanned: DataFrame, **settings) -> DataFrame:
    """row, found: the candidates in trusted patterns, of the rows that have any."""
    patterns = trusted_patterns(scanned, **settings)
    instances = scanned.select("row", F.explode("candidates").alias("s")).select("row", "s", F.explode(F.expr(_patterns("s"))).alias("pattern"))
    return instances.join(patterns, "pattern").groupBy("row").agg(
        F.array_sort(F.collect_set(F.expr("struct(s.kind as kind, s.start as start, s.end as end)"))).alias("found")
    )


def personal_spans(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, base and found spans (kind, start, end) and the hash of the text, a row for each document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = _scanned(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "base", "candidates"
    )
    scanned = stash(scanned, "scanned")
    return scanned.join(_found(scanned, **settings), "row", "left").select(
        "doc_id", "text_hash", F.expr(_PLAIN.format("base")).alias("base"), F.coalesce("found", F.expr(_NONE)).alias("found"),
    )


def redact(documents: DataFrame, **settings) -> DataFrame:
    """The documents with every span of their texts replaced by its kind, like ``[EMAIL]``.

    Overlapping spans become one, named after the first, of equal starts the longest. Columns stay as they are;
    n_chars, where there is one, follows the text.

    Each document is written beside its spans, so they need no join. Spans found by context are
    written first: where they are few, which their size tells, no text is shuffled for them.
    """
    whole = documents.select(F.struct(*documents.columns).alias("doc"), F.col("text").cast("string").alias("text"))
    scanned = stash(_scanned(whole).select(F.monotonically_increasing_id().alias("row"), "doc", "base", "candidates"), "scanned")
    found = stash(_found(scanned, **settings), "found")
    both = scanned.join(found, "row", "left").select(
        "doc", F.col("doc.text").cast("string").alias("text"),
        F.expr(f"concat({_PLAIN.format('base')}, coalesce(found, {_NONE}))").alias("spans"),
    )
    sorted_spans = F.expr("array_sort(transform(spans, s -> struct(s.start as start, -s.end as back, s.end as end, s.kind as kind)))")
    one = "array<struct<start:bigint,back:bigint,end:bigint,kind:string>>"
    merged = f"""aggregate(spans, cast(array() as {one}), (a, s) -> if(size(a) > 0 and element_at(a, -1).end > s.start,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'back', element_at(a, -1).back, 'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind))),
        concat(a, array(s))))"""
    pieces = """array_join(transform(sequence(0, size(spans)), i -> concat(
        substring(text, cast(if(i = 0, 0L, spans[i - 1].end) as int) + 1,
            cast(if(i = size(spans), length(text), spans[i].start) - if(i = 0, 0L, spans[i - 1].end) as int)),
        if(i = size(spans), '', concat('[', upper(spans[i].kind), ']')))), '')"""
    out = both.withColumn("spans", sorted_spans).withColumn("spans", F.expr(merged))
    out = out.withColumn("text", F.expr(f"if(size(spans) = 0, text, {pieces})"))

    def column(name: str) -> Column:
        kind = documents.schema[name].dataType
        if name == "text":
            return F.col("text").cast(kind).alias(name)
        if name == "n_chars":
            return F.when(F.size("spans") == 0, F.col("doc.n_chars")).otherwise(F.length("text")).cast(kind).alias(name)
        return F.col("doc")[name].alias(name)

    return out.select(*[column(c) for c in documents.columns])
