"""Code-structure tables from a lexical token table.

The corpus is spread by idx while it is still compact text; every window, aggregate and explode that
follows works on idx within those partitions, so tokens themselves are not shuffled. A window spans
the tokens of one function only, which came out of one row. On straight-line code the tables agree
with a grammar walk; elsewhere they are approximations, noted where they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.functions import c_words as fixed
from verdigraph.functions.text import NOT_SPACE, SPACE, strip_comments
from verdigraph.operators.scale import spread

# Java form of the token pattern: possessive quantifiers keep long literals off the stack.
TOKEN = (
    r"""(?s)"(?:[^\\"]++|\\.)*+"|'(?:[^\\']++|\\.)*+'|"""
    + f"{fixed.NAME}|{fixed.NUMBER}|{fixed.OPERATOR}|{NOT_SPACE}"
)


# What a name begins with, and operators by text: sets are looked up where patterns are run.
NAME_START = tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
PLAIN_OPERATORS = (*"()[]{};,.=+-*/%<>!&|^~?:", "->", "++", "--", "==", "!=", "<=", ">=", "&&", "||", "<<", ">>", *fixed.ASSIGNING[1:])


def starts_name(text: Column) -> Column:
    return F.substring(text, 1, 1).isin(*NAME_START)


def token_kind(text: Column) -> Column:
    """keyword, type, ident, number, string, char or op."""
    first = F.substring(text, 1, 1)
    return (
        F.when(text.isin(*PLAIN_OPERATORS), "op")
        .when(text.isin(*fixed.KEYWORDS), "keyword")
        .when(text.isin(*fixed.TYPE_WORDS), "type")
        .when(first.isin(*NAME_START), "ident")
        .when(text.rlike(r"^\.?[0-9]"), "number")
        .when((first == '"') & (F.length(text) > 1), "string")
        .when((first == "'") & (F.length(text) > 1), "char")
        .otherwise("op")
    )


def is_ident(text: Column) -> Column:
    """As ``token_kind(text) == "ident"``, decided by the first letter for most tokens; false for null."""
    return F.coalesce(starts_name(text) & ~text.isin(*fixed.KEYWORDS, *fixed.TYPE_WORDS), F.lit(False))


# As above with a member chain (a->b[i].c) as one token; a subscript that holds a call ends the chain.
CHAIN = f"{fixed.NAME}(?:{SPACE}*(?:->|\\.){SPACE}*{fixed.NAME}|{SPACE}*\\[[^\\[\\]()]*\\])*"
CHAIN_TOKEN = TOKEN.replace(f"|{fixed.NAME}|", f"|{CHAIN}+|", 1)
# A name in a chain that is no member of another.
OUTER_NAME = r"(?<!\.)(?<!->)(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*"


# Text up to the next ; { or } outside literals.
STATEMENT = r"""(?s)(?:[^;{}"']++|"(?:[^\\"]++|\\.)*+"|'(?:[^\\']++|\\.)*+'|["'])++[;{}]?+|[;{}]"""


def by_function(df: DataFrame, text: str = "func") -> DataFrame:
    """idx and comment-free source, spread by idx as compact text."""
    dealt = spread(df.select("idx", F.col(text).alias("_raw")), "idx", "_raw")
    return dealt.select("idx", strip_comments("_raw").alias("_source"))


def split_tokens(source: Column, chains: bool = False) -> Column:
    """Token texts of a source as an array; ``chains`` takes names joined by ``.``, ``->`` or a subscript as one."""
    return F.regexp_extract_all(source, F.lit(CHAIN_TOKEN if chains else TOKEN), F.lit(0))


def tokens(df: DataFrame, text: str = "func", chains: bool = False) -> DataFrame:
    """idx, pos, text, kind, before, next, through: tokens in source order with their neighbours' texts.

    ``through`` marks the bracket that opens a call through a pointer, ``(*f)(``.

    Literals stay whole, comments are gone. Neighbours are read off the array before it is unrolled,
    so looking one token ahead or back needs no window.
    """
    listed = by_function(df, text).select("idx", split_tokens(F.col("_source"), chains).alias("_l"))
    near = F.transform(
        "_l",
        lambda x, i: F.struct(
            x.alias("text"),
            F.when(i > 0, F.get("_l", i - 1)).otherwise(F.lit("")).alias("before"),
            F.coalesce(F.get("_l", i + 1), F.lit("")).alias("next"),
            F.coalesce(
                (x == "(") & (F.get("_l", i + 1) == "*") & (F.get("_l", i + 3) == ")") & (F.get("_l", i + 4) == "(")
                & (token_kind(F.get("_l", i + 2)) == "ident"),
                F.lit(False),
            ).alias("through"),
        ),
    )
    rows = listed.select("idx", F.posexplode(near).alias("pos", "_t")).select("idx", "pos", "_t.*")
    if chains:
        name = F.col("text").rlike("^[A-Za-z_]")
        rows = rows.withColumn("text", F.when(name, F.regexp_replace("text", SPACE, "")).otherwise(F.col("text")))
    return rows.select("idx", "pos", "text", token_kind(F.col("text")).alias("kind"), "before", "next", "through")


def is_type_name() -> Column:
    """A name after ``struct``, ``union`` or ``enum``, or right before another name."""
    return F.col("before").isin(*fixed.TAGGED_TYPES) | (token_kind(F.col("next")) == "ident")


def identifiers(toks: DataFrame) -> DataFrame:
    """Distinct names per function, members after ``.`` or ``->`` and names of types left out."""
    names = toks.where((F.col("kind") == "ident") & ~F.col("before").isin(*fixed.MEMBER) & ~is_type_name())
    return names.select("idx", "text").distinct()


def _with_depth(chained: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    brace = F.when(F.col("text") == "{", 1).when(F.col("text") == "}", -1).otherwise(0)
    return chained.withColumn("_depth", F.sum(brace).over(so_far))


def _is_call() -> Column:
    declares = token_kind(F.col("before")).isin("ident", "type")
    named = (F.col("kind") == "ident") & (F.col("next") == "(") & ~declares
    through = F.col("through") & ~token_kind(F.col("before")).isin("ident", "type", "keyword")
    return (named | through) & (F.col("_depth") > 0)


def _callee() -> Column:
    """The text before a call's first bracket: nothing, if it goes through a pointer."""
    return F.when(F.col("kind") == "ident", F.col("text")).otherwise(F.lit(""))


def call_sites(df: DataFrame, text: str = "func") -> DataFrame:
    """idx, ord, callee in source order; member chains ``a->b`` and ``a[i].b`` kept, repeats kept.

    A call is a name before ``(`` inside a body; a name right after another name or a type declares.
    ``(*f)(x)`` is a call whose callee is empty.
    A chain that does not start at a name (``f(x)->g``) keeps what follows that start. Only braces and
    names before ``(`` enter the window that counts depth.
    """
    named = (F.col("kind") == "ident") & (F.col("next") == "(")
    seen = _with_depth(tokens(df, text, chains=True).where(named | F.col("through") | F.col("text").isin("{", "}")))
    ordered = Window.partitionBy("idx").orderBy("pos")
    return seen.where(_is_call()).select("idx", F.row_number().over(ordered).alias("ord"), _callee().alias("callee"))


def distinct_calls(calls: DataFrame) -> DataFrame:
    return calls.select("idx", "callee").distinct()


def call_sentence(calls: DataFrame) -> DataFrame:
    """idx, text: "The program first calls A, then calls B, and finally calls C."

    A single call gives the opening alone; a function without calls has no row.
    """
    listed = calls.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("ord", "callee"))).alias("_calls"))

    def part(call: Column, i: Column) -> Column:
        name = call["callee"]
        return (
            F.when(i == 0, F.concat(F.lit("The program first calls "), name, F.lit(", ")))
            .when(i == F.size("_calls") - 1, F.concat(F.lit("and finally calls "), name, F.lit(".")))
            .otherwise(F.concat(F.lit("then calls "), name, F.lit(", ")))
        )

    return listed.select("idx", F.array_join(F.transform("_calls", part), "").alias("text"))


def called_names(callee: Column) -> Column:
    """Names that a callee text takes out of the variables, as an array.

    A name goes when the callee ends with it, has it at a word's start and not as a member; or when
    it stands right before ``<``. Both are suffixes of some word, so they are listed from the callee
    itself and matched by equality instead of testing every pair of name and call.
    """
    tail = F.regexp_extract(callee, r"\w+\z", 0)
    spaced = F.concat(F.lit(" "), F.regexp_replace(callee, r"\W", " "))

    def suffixes(word: Column) -> Column:
        n = F.length(word)
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(word, i))

    def taken(name: Column) -> Column:
        at_start = F.contains(spaced, F.concat(F.lit(" "), name))
        member = F.contains(callee, F.concat(F.lit("->"), name)) | F.contains(callee, F.concat(F.lit("."), name))
        return at_start & ~member

    before_angle = F.regexp_extract_all(callee, F.lit(r"(\w+)<"), F.lit(1))
    return F.array_distinct(
        F.concat(F.filter(suffixes(tail), taken), F.flatten(F.transform(before_angle, suffixes)))
    )


def variables(ids: DataFrame, calls: DataFrame) -> DataFrame:
    """Names of a function that none of its calls takes out, from two tables.

    Both shrink to distinct names per function before they meet in one aggregate.
    """
    none = F.lit(None).cast("string")
    both = ids.select("idx", F.col("text").alias("_id"), none.alias("_callee")).unionByName(
        calls.select("idx", none.alias("_id"), F.col("callee").alias("_callee"))
    )
    return _untaken(both.groupBy("idx").agg(F.collect_set("_id").alias("_ids"), F.collect_set("_callee").alias("_callees")))


def _untaken(named: DataFrame) -> DataFrame:
    taken = F.flatten(F.transform("_callees", called_names))
    return named.select("idx", F.explode(F.array_except("_ids", taken)).alias("text"))


def function_variables(df: DataFrame, text: str = "func") -> DataFrame:
    """As :func:`variables`, straight from source: names and calls of one pass over glued chains.

    A chain's first name is an identifier unless it follows a member operator or names a type; the names in
    its subscripts are identifiers too, the rest are members.
    """
    seen = _with_depth(tokens(df, text, chains=True).where((F.col("kind") == "ident") | F.col("through") | F.col("text").isin("{", "}")))
    names = F.regexp_extract_all("text", F.lit(OUTER_NAME), F.lit(0))
    inner = F.filter(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), lambda x: token_kind(x) == "ident")
    first = F.when(F.col("before").isin(*fixed.MEMBER) | is_type_name(), F.array().cast("array<string>")).otherwise(F.slice(names, 1, 1))
    found = F.when(F.col("kind") == "ident", F.concat(first, inner))
    named = seen.groupBy("idx").agg(
        F.array_distinct(F.flatten(F.collect_set(found))).alias("_ids"), F.collect_set(F.when(_is_call(), _callee())).alias("_callees")
    )
    return _untaken(named)
