"""Query text: canonical form, tags and predicates, as native column expressions.

Null texts stay null unless a function says otherwise. Patterns follow the reference's rules for
white space and letter case over all of Unicode, and ``.`` stops at line feeds alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSES = 3

# Labels of queries by id.
LABELS = ["normal", "union_based", "error_based", "boolean_blind", "time_blind", "stacked"]

# What marks each attack class, in the order in which classes are tried.
ATTACK_RULES = [
    (5, r";\s*(DROP|INSERT|UPDATE|DELETE|EXEC|TRUNCATE|CREATE|GRANT|ALTER)"),
    (4, r"SLEEP\(|BENCHMARK\(|WAITFOR\s+DELAY|PG_SLEEP\("),
    (2, r"EXTRACTVALUE|UPDATEXML|FLOOR\(RAND|CAST\(.*AS|CONVERT\("),
    (1, r"UNION\s+(ALL\s+)?SELECT"),
    (3, r"(OR|AND)\s+\d+\s*=\s*\d+|'\s*OR\s*'?1'?\s*=\s*'?1"),
]
# Marks of other attacks: operating-system commands (case counts), server-side includes, scripts.
COMMAND_RULE = r"[;&|]\s*(cat|whoami|ping|wget|curl|nc)\s|\$\(|`[^`]+`|\(\)\s*\{\s*:;\s*\}"
OTHER_RULES = [r"<!--#(exec|include|echo)\s", r"<script[^>]*>|javascript:|on(error|load)\s*="]
# Call-backs that leak into benign pools, and the path of one over-represented template.
CALLBACKS = ["owasp.org", "/etc/passwd", "shellshock"]
TEMPLATE_PATH = "/blog/index.php/2020/03"

ANY_CASE = "(?iUd)"


def comment_marker(text: Column) -> Column:
    """1 if the text holds a block comment or two dashes, else 0."""
    return F.rlike(text, F.lit(r"(?s)/\*.*?\*/|--")).cast("int")


def url_decoded(text: Column, passes: int = PASSES) -> Column:
    """Percent-decoding and plus to space, so many times; a malformed percent sign stays."""
    def decoded(t: Column) -> Column:
        some = F.contains(t, F.lit("%")) | F.contains(t, F.lit("+"))
        return F.when(some, F.url_decode(F.regexp_replace(t, "%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(t)

    for _ in range(passes):
        text = _once(text, decoded)
    return text


def _once(text: Column, use) -> Column:
    """use(text), where text is evaluated once however often it is used: nested uses would otherwise multiply."""
    return F.get(F.transform(F.array(text), use), F.lit(0))


def _each_match(text: Column, pattern: str, new) -> Column:
    """The text with every match replaced by new(whole match, group 1)."""
    between = F.split(text, pattern, -1)
    wholes, groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    replaced = F.concat(F.zip_with(wholes, groups, new), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, replaced, lambda a, b: F.concat(a, b)), "")


def hex_literals(text: Column) -> Column:
    """0x.. literals of printable ASCII as quoted text; others stay."""
    printable = r"^(?:[2-6][0-9a-fA-F]|7[0-9a-eA-E])+$"
    new = lambda whole, digits: F.when(F.rlike(digits, F.lit(printable)), F.concat(F.lit("'"), F.decode(F.unhex(digits), "UTF-8"), F.lit("'"))).otherwise(whole)
    return _once(text, lambda t: F.when(F.contains(t, F.lit("0x")), _each_match(t, "0x([0-9a-fA-F]{2,})", new)).otherwise(t))


def char_calls(text: Column) -> Column:
    """CHAR(65, 66) as quoted text, also at the end of a longer name; codes beyond Unicode stay as they are."""

    def new(whole: Column, codes: Column) -> Column:
        numbers = F.transform(F.split(codes, r"\s*,\s*"), lambda n: n.try_cast("bigint"))
        fine = F.forall(numbers, lambda n: F.coalesce(n <= 0x10FFFF, F.lit(False)))
        signs = F.transform(numbers, lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        return F.when(fine, F.concat(F.lit("'"), F.array_join(signs, ""), F.lit("'"))).otherwise(whole)

    calls = r"(?iU)CHAR\s*\(\s*([0-9]+(?:\s*,\s*[0-9]+)*)\s*\)"
    return _once(text, lambda t: F.when(F.rlike(t, F.lit(calls)), _each_match(t, calls, new)).otherwise(t))


def canonical(text: Column, passes: int = PASSES) -> Column:
    """URL, hexadecimal and CHAR encodings undone, in lower case."""
    return F.lower(char_calls(hex_literals(url_decoded(text, passes))))


def cleaned(text: Column) -> Column:
    """Without control characters; white space single and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"(?U)\s+", " "))


def without_wrapper(text: Column) -> Column:
    """What follows the first question mark or white space; empty if there is neither."""
    return F.regexp_replace(F.regexp_extract(text, r"(?sU)[\s?](.*)$", 1), r"(?U)^\s+|\s+$", "")


def attack_tag(text: Column) -> Column:
    """Class of a text known to be an attack; boolean_blind where no rule matches."""
    out = F.lit(3)
    for label, rule in reversed(ATTACK_RULES):
        out = F.when(F.rlike(text, F.lit(ANY_CASE + rule)), label).otherwise(out)
    return out


def tag(text: Column, is_attack: Column) -> Column:
    """Class id of a labelled text."""
    return F.when(is_attack, attack_tag(text)).otherwise(0)


def any_signature(text: Column) -> Column:
    """Whether any attack rule matches."""
    rules = [ANY_CASE + r for _, r in ATTACK_RULES] + [ANY_CASE + r for r in OTHER_RULES] + ["(?U)" + COMMAND_RULE]
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(r)) for r in rules])


def is_callback(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(c)) for c in CALLBACKS])


def is_template(text: Column) -> Column:
    return F.contains(text, F.lit(TEMPLATE_PATH))


def probe_target(text: Column) -> Column:
    """The x of username='x'; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?U)username\s*=\s*'([^']+)'", 1), F.lit(""))


def label_name(label: Column) -> Column:
    """Name of a label given as id or as name; other values stay."""
    names = F.create_map(*[x for i, n in enumerate(LABELS) for x in (F.lit(str(i)), F.lit(n))])
    return F.coalesce(F.try_element_at(names, label.cast("string")), label.cast("string"))


def label_id(label: Column) -> Column:
    """Id of a label given as id or as name; null for others."""
    ids = F.create_map(*[x for i, n in enumerate(LABELS) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(F.try_element_at(ids, label.cast("string")), label.try_cast("int"))


def fragments(text: Column, parts: int, seed: int = 0) -> Column:
    """A payload in at most so many runs of its tokens, cut at places that a hash of it chooses. Joined by nothing they are the payload's tokens."""
    tokens = F.filter(F.split(text, r"(?<=[\s(),;])|(?=[(),;])"), lambda t: F.trim(t) != "")
    size = F.size(tokens)
    places = F.array_sort(F.slice(F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.struct(F.xxhash64(text, i, F.lit(seed)).alias("h"), i.alias("at")))), 1, F.least(F.lit(parts - 1), F.greatest(size - 1, F.lit(0)))).getField("at"))
    starts, ends = F.concat(F.array(F.lit(0)), places), F.concat(places, F.array(size))
    return F.when(size > 0, F.zip_with(starts, ends, lambda a, b: F.trim(F.array_join(F.slice(tokens, a + 1, b - a), "")))).otherwise(F.array().cast("array<string>"))


def characters(text: Column) -> Column:
    """The code points of a text, each as a string."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def word_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within words, each word between two spaces; a word shorter than n gives itself once."""

    def of(word: Column) -> Column:
        size = F.length(word)
        return F.flatten(F.transform(F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), size))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(word, i, n))))

    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: of(F.concat(F.lit(" "), w, F.lit(" ")))))


def char_vocabulary(df: DataFrame, text: str, top: int) -> DataFrame:
    """The most frequent characters (ties by the character) and their ids from 2; top rows at most."""
    from pyspark.sql import Window as W

    counts = df.select(F.explode(characters(F.col(text))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch").limit(top)
    return counts.select("ch", "n", (F.row_number().over(W.orderBy(F.desc("n"), "ch")) + 1).alias("id"))


def char_ids(text: Column, vocabulary: dict[str, int], length: int) -> Column:
    """Ids of the first characters, 1 for unknown ones, filled up with 0."""
    ids = F.create_map(*[F.lit(x) for pair in sorted(vocabulary.items()) for x in pair]) if vocabulary else F.create_map().cast("map<string,int>")
    found = F.transform(F.slice(characters(text), 1, length), lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(1)))
    return F.concat(found, F.array_repeat(F.lit(0), length - F.size(found)))


def canonicalize(df: DataFrame, text: str = "query_raw", passes: int = PASSES) -> DataFrame:
    """df with query_canonical and has_comment_marker."""
    return df.withColumns({"query_canonical": canonical(F.col(text), passes), "has_comment_marker": comment_marker(F.col(text))})


def tagged(df: DataFrame, text: str = "query_canonical", is_attack: str = "is_attack") -> DataFrame:
    """df with label and label_name."""
    return df.withColumn("label", tag(F.col(text), F.col(is_attack))).withColumn("label_name", label_name(F.col("label")))


def create_sql_functions(spark) -> None:
    """Temporary SQL functions for SQL users: tw_comment_marker, tw_is_callback, tw_clean, tw_probe_target."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION tw_comment_marker(t STRING) RETURNS INT RETURN CAST(t RLIKE r'(?s)/\*.*?\*/|--' AS INT)")
    tests = " OR ".join(f"contains(lower(t), '{c}')" for c in CALLBACKS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tw_is_callback(t STRING) RETURNS BOOLEAN RETURN {tests}")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION tw_clean(t STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(t, r'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ''), r'(?U)\s+', ' '))")
    spark.sql('CREATE OR REPLACE TEMPORARY FUNCTION tw_probe_target(t STRING) RETURNS STRING RETURN nullif(regexp_extract(t, r"username\\s*=\\s*\'([^\']+)\'", 1), "")'.replace("\\\\", "\\"))
