"""Pieces of the checking SQL shared by several queries (RE2 patterns, lambda syntax)."""

from verdigraph.functions import c_words
from verdigraph.functions.text import NOT_SPACE, SPACE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '{NOT_SPACE}+')"


def spaced(c: str) -> str:
    return f"regexp_extract_all({c}, '{SPACE}*{NOT_SPACE}+|{SPACE}+')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+\\z', '', 'g')"


def join_list(c: str) -> str:
    return f"coalesce(array_to_string({c}, ' '), '')"


def repeat(value: str, times: str) -> str:
    return f"list_transform(range(greatest({times}, 0)), lambda i: CAST({value} AS BIGINT))"


PIECE = r"""(?s)//[^\n]*|/\*.*?\*/|'(?:[^\\']|\\.)*'|"(?:[^\\"]|\\.)*"|[^/'"]+|."""


def uncommented(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, {quoted(PIECE)}), "
        "lambda p: CASE WHEN starts_with(p, '//') OR starts_with(p, '/*') THEN ' ' ELSE p END), '')"
    )


def strip_comments(c: str) -> str:
    return (
        f"coalesce(array_to_string(list_filter(string_split({uncommented(c)}, chr(10)), "
        f"lambda s: regexp_matches(s, '{NOT_SPACE}')), chr(10)), '')"
    )


def in_list(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


TOKEN = f"(?s){c_words.STRING}|{c_words.CHAR}|{c_words.NAME}|{c_words.NUMBER}|{c_words.OPERATOR}|{NOT_SPACE}"
KIND = f"""CASE WHEN text IN {in_list(c_words.KEYWORDS)} THEN 'keyword' WHEN text IN {in_list(c_words.TYPE_WORDS)} THEN 'type'
 WHEN regexp_matches(text, '^[A-Za-z_]') THEN 'ident' WHEN regexp_matches(text, '^\\.?[0-9]') THEN 'number'
 WHEN text LIKE '"_%' THEN 'string' WHEN text LIKE '''_%' THEN 'char' ELSE 'op' END"""


def tokens_cte(corpus_sql: str) -> str:
    """toks(idx, pos, text, kind)."""
    return f"""code AS ({corpus_sql}),
 listed AS (SELECT idx, regexp_extract_all({uncommented('func')}, {quoted(TOKEN)}) AS l FROM code),
 cut AS (SELECT idx, CAST(u.i - 1 AS INTEGER) AS pos, u.w AS text FROM listed, unnest(listed.l) WITH ORDINALITY AS u(w, i)),
 toks AS (SELECT idx, pos, text, {KIND} AS kind FROM cut)"""
