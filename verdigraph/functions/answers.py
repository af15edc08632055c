"""Reading a 0/1 verdict out of free-text answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigraph.functions import answer_rules as fixed
from verdigraph.functions.arrays import let


def simple_verdict(c: Column) -> Column:
    """1 or 0 by substring of the lower-cased text, null when neither list hits."""

    def judge(low: Column) -> Column:
        def holds(parts):
            return reduce(lambda a, b: a | b, [low.contains(p) for p in parts])

        return F.when(holds(fixed.SIMPLE_YES), F.lit(1)).when(holds(fixed.SIMPLE_NO), F.lit(0))

    return let(F.lower(c), judge)


def cut_at_question(c: Column, prompt_type: Column) -> Column:
    """Zero-shot answers end where the model starts to ask a new question."""
    runs_on = (prompt_type == "zero_shot") & c.contains(fixed.QUESTION) & ~c.startswith(fixed.QUESTION_HEAD)
    return F.when(runs_on, F.substring_index(c, fixed.QUESTION, 1)).otherwise(c)


def drop_fenced_block(c: Column) -> Column:
    """Remove the first fenced block; an unclosed one makes the tail restart at character 3."""
    width = len(fixed.FENCE)
    first = F.position(F.lit(fixed.FENCE), c)
    second = F.position(F.lit(fixed.FENCE), c, first + width)  # 0 when unclosed
    rest = F.concat(F.substr(c, F.lit(1), first - 1), F.substr(c, second + width))
    return F.when(first == 0, c).otherwise(rest)


def one_answer_line(c: Column) -> Column:
    """While the text holds a reasoning mark, a line starting with the answer mark replaces it."""
    lines = F.filter(F.split(c, fixed.LINE_BREAK), lambda line: F.startswith(F.lower(line), F.lit(fixed.ANSWER_HEAD)))
    return F.aggregate(lines, c, lambda text, line: F.when(text.contains(fixed.REASONING), line).otherwise(text))


def trim_answer(c: Column, family: Column) -> Column:
    """Cut at the family's end marks."""
    out = F.when(family.isNull(), c)
    for name, ends in fixed.ANSWER_ENDS.items():
        out = out.when(family == name, reduce(lambda text, mark: F.substring_index(text, mark, 1), ends, c))
    return out


def answer_family(model: Column) -> Column:
    """Family by part of the model's name; an unknown name is an error."""
    first_part, first_family = fixed.ANSWER_FAMILIES[0]
    out = F.when(model.contains(first_part), F.lit(first_family))
    for part, family in fixed.ANSWER_FAMILIES[1:]:
        out = out.when(model.contains(part), F.lit(family))
    return out.otherwise(F.raise_error(F.concat(F.lit("no answer family for model "), model)))


def rule_holds(c: Column, rule) -> Column:
    """Whether some match of the rule's pattern is free of every voiding pattern."""
    _, pattern, voids, needs = rule
    pattern = fixed.FLAGS + pattern

    def present(need: str) -> Column:
        return c.endswith(need[:-1]) if need.endswith(fixed.END) else c.contains(need)

    possible = reduce(lambda a, b: a | b, [present(n) for n in needs])
    if not voids:
        return possible & c.rlike(pattern)

    def stands(match: Column) -> Column:
        return reduce(lambda a, b: a & b, [~match.rlike(fixed.FLAGS + v) for v in voids])

    return possible & F.exists(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), stands)


def rule_verdict(c: Column) -> Column:
    """1 vulnerable, 0 not, 2 undecided. ``c`` should be a plain column: it is read once per rule."""

    def any_of(rules):
        return reduce(lambda a, b: a | b, [rule_holds(c, r) for r in rules])

    return (
        F.when(any_of(fixed.VULNERABLE_RULES), F.lit(1))
        .when(any_of(fixed.SOUND_RULES), F.lit(0))
        .when(any_of(fixed.LATE_VULNERABLE_RULES), F.lit(1))
        .otherwise(F.lit(2))
    )


def first_paragraph(c: Column) -> Column:
    """Text up to the first blank line, code-fence openers counting as one."""
    return F.substring_index(F.regexp_replace(c, fixed.FENCE_OPENER, "\n\n"), "\n\n", 1)
