"""Raw text to lines, merged lines, sentences and claims, and the rules that sort claims. All native expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines that are page furniture or citations rather than content. Surrounding ".*" is left out, as the
# patterns are searched for anywhere in a line.
BOILERPLATE = (
    "^skip to main content$", "^credits?$", "^share$", "^print$", "^related$", "^see also$", "^references?$", "^key facts?$", "^overview$", "^reading time:?",
    "^[0-9]{1,2} (january|february|march|april|may|june|july|august|september|october|november|december) [0-9]{4}$",
    "^who$|^paho$|^ncdc$|^nphcda$|^fmoh$", "official government organization", r"safely connected.*\.gov", "substitute for professional medical care", "medlineplus also links to",
    r"^(article|journal|report|reference|study|source):\s", r"accessed [0-9]{1,2} \w+ [0-9]{4}", r"\bet al\.?\s*$|\bet al\.?,", r"^\([0-9]+\)\s",
    r"^[A-Z][a-zA-Z ]{2,25}:\s.*;\s*[0-9]{4}", r"^licen[cs]e:\s|\bcc by(-nc)?(-sa)?\b", r"\bdoi:|doi\.org|\b10\.[0-9]{4,9}/", r"\bwebpage\.?\s*$",
    r",\s*[0-9]+,?\s*[0-9]*\s*\([0-9]{4}\)\.?\s*$", r"\[online database\]",
)
BOILERPLATE_PATTERN = "(?i)" + "|".join(f"(?:{p})" for p in BOILERPLATE)
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Without white space at the ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_boilerplate(line: Column) -> Column:
    return strip(line).rlike(BOILERPLATE_PATTERN)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is named: as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged_lines(text: Column) -> Column:
    """Lines with wrapped sentences joined: a line goes on the one before it if that has no end mark and this begins
    in lower case or with a comma, semicolon or closing bracket. Blank lines part, boilerplate lines stand alone.

    Whether a line goes on depends on its neighbour only, so the fold is a join with two kinds of separators."""
    lines = F.transform(F.split(text, LINE_ENDS), strip)
    plain = F.transform(lines, lambda s: F.struct(s.alias("s"), ((s != "") & ~s.rlike(BOILERPLATE_PATTERN)).alias("p")))

    def joined(b: Column, x: Column) -> Column:
        goes_on = x["p"] & b["p"] & ~b["s"].rlike(r"[.!?:]$") & x["s"].rlike(r"^[\p{Ll},;)]")
        return F.concat(F.when(goes_on, " ").otherwise("\u0001"), x["s"])

    def folded(plain: Column) -> Column:
        # each line beside the one before it: a lambda that looked back into the array would evaluate it anew per line
        before = F.concat(F.array(F.struct(F.lit("").alias("s"), F.lit(False).alias("p"))), F.slice(plain, F.lit(1), F.greatest(F.size(plain) - 1, F.lit(0))))
        return F.array_join(F.zip_with(before, plain, joined), "")

    return F.filter(F.split(_bound(plain, folded), "\u0001"), lambda s: s != "")


def looks_like_a_sentence(text: Column, words: int = 5) -> Column:
    """Ends in a full stop or exclamation mark, isn't wholly in brackets, has enough words, begins like a sentence."""
    return text.rlike(r"[.!]$") & ~text.rlike(r"^\([\s\S]*\)$") & (F.size(F.split(text, r"(?U)\s+")) >= words) & text.rlike("^[\\p{Lu}\\p{Nd}\"'“(]")


def claims(text: Column, least: int = 25, most: int = 400) -> Column:
    """The atomic claims of a text, in order."""
    lines = F.filter(merged_lines(text), lambda s: ~s.rlike(BOILERPLATE_PATTERN))
    parts = F.transform(F.flatten(F.transform(lines, lambda s: F.split(s, r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"))), strip)
    return F.filter(parts, lambda s: F.length(s).between(least, most) & ~s.rlike(BOILERPLATE_PATTERN) & looks_like_a_sentence(s))


def exploded_claims(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, position, claim, claim_id): one row per claim, numbered within its text."""
    rows = df.select(F.col(key), F.col(source), F.posexplode(claims(F.col(text))).alias("position", "claim"))
    return rows.withColumn("claim_id", F.format_string("%s-%s-%03d", F.coalesce(F.col(source), F.lit("unknown")), F.col(key), F.col("position")))


@dataclass(frozen=True)
class Category:
    """A rule of the claim sorter: any trigger in the lower-cased claim, if the topic is allowed."""

    name: str
    triggers: tuple[str, ...]
    template: str
    only: tuple[str, ...] = ()
    never: tuple[str, ...] = field(default=())


def classify(claim: Column, topic: Column, categories: list[Category]) -> Column:
    """The first category, in the order given, that fits; null if none does."""
    low, out = F.lower(claim), F.lit(None).cast("string")
    for c in reversed(categories):
        fits = F.lit(False)
        for word in c.triggers:
            fits = fits | F.contains(low, F.lit(word))
        if c.only:
            fits = fits & topic.isin(*c.only)
        if c.never:
            fits = fits & ~topic.isin(*c.never)
        out = F.when(fits, F.lit(c.name)).otherwise(out)
    return out


def question_for(category: Column, topic: Column, categories: list[Category], generic: str) -> Column:
    """The category's template, or the generic one, with the topic put in."""
    template = F.lit(generic)
    for c in categories:
        template = F.when(category == c.name, F.lit(c.template)).otherwise(template)
    return F.replace(template, F.lit("{topic}"), topic)


def slug_topic(slug: Column, topics: dict[str, str], valid: tuple[str, ...]) -> Column:
    """The topic of a slug; null if it has none, or one that is not valid."""
    pairs = F.create_map(*[F.lit(x) for kv in topics.items() if kv[1] in valid for x in kv])
    return F.element_at(pairs, slug)


def source_reference(source: Column, slug: Column, date: Column, licence: Column) -> Column:
    return F.format_string("%s (%s), retrieved %s, licence: %s", source, slug, date, licence)


def with_question(df: DataFrame, claim: str, topic: str, categories: list[Category], generic: str, backend: Callable[[DataFrame], DataFrame] | None = None, name: str = "model") -> DataFrame:
    """df with question and backend_used. backend(df) adds `asked`; where that is null or no question, the template
    stands in and backend_used says so. Without a backend the template is the backend."""
    template = question_for(classify(F.col(claim), F.col(topic), categories), F.col(topic), categories, generic)
    if backend is None:
        return df.withColumns({"question": template, "backend_used": F.lit("template")})
    asked = F.trim(F.col("asked"))
    good = F.coalesce(F.endswith(asked, F.lit("?")), F.lit(False))
    return backend(df).withColumns({"question": F.when(good, asked).otherwise(template), "backend_used": F.when(good, name).otherwise("template_fallback")}).drop("asked")


def running_ids(df: DataFrame, order: list[str], pattern: str = "rec-%06d", first: int = 1) -> DataFrame:
    """df with `id` numbered over a total order, without one task that holds all rows: range partitions are counted
    and each adds its own number to its partition's offset."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_k", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33))
    from cowrie.session import cut  # partition numbers must not change between the count and the use

    fixed = cut(ranged.drop("_m"), "ordered")
    sizes = fixed.groupBy("_p").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # one row per partition
    return fixed.join(F.broadcast(before), "_p").withColumn("id", F.format_string(pattern, F.col("_before") + F.col("_k") + first)).drop("_p", "_k", "_before")
