"""Fixed values of answer reading: word lists, patterns and markers, in Java regex syntax.

``(?U)`` makes word boundaries Unicode-aware and ``(?d)`` lets ``$`` see only a newline.
A rule is (name, pattern, patterns that void a single match of it, needs). A text with none of the
needs cannot match the pattern, and finding that out by plain search is far cheaper than the pattern;
``END`` marks a need that must end the text.
"""

from __future__ import annotations

FLAGS = "(?Ud)"

# Words that name a weakness.
WEAKNESS = (
    r"\b(bug|buggy|bugs|potentially buggy|cwe|cwes|issue|issues|flaw|flaws|"
    r"vulnerabilities|vulnerability|vulnerable|"
    r"buffer-overflow|buffer overflow|memory-leak|memory leak|race-condition|race condition|"
    r"use-after-free|use after free|segmentation fault|undefined behavior|unexpected behavior|"
    r"integer-overflow|integer overflow|crash)\b"
)
# Fixed value: the same list as the second voiding set reads it, blanks inside phrases lost.
WEAKNESS_UNSPACED = WEAKNESS.replace(" ", "")
WEAK_ADJECTIVE = r"\b(buggy|potentially buggy|vulnerable)\b"
SOUND_ADJECTIVE = (
    r"\b(correct|fine|bug-free|well-|correctly|valid|functioning as intended|safe|secure|straightforward)\b"
)

# Phrases that void one match of a weakness rule.
DENIES_WEAKNESS = (
    r"\b(((is not|does not|does not appear to|unlikely to|not likely to)[\s\x1c-\x1f]+"
    r"(perform|performing|seem to be performing|involve|contain|affected by|check|have))"
    r"|no|free of|or perform any|not prone to)\b[^.;\n]+(operation|operations|" + WEAKNESS + r")"
)
DENIES_STATE = (
    r"\b(((is not|unlikely to|not likely to)[\s\x1c-\x1f]+(perform|involve|contain|affected by|check)))\b"
    r"[^.;\n]+(operation|operations|" + WEAKNESS_UNSPACED + r")"
)
CANNOT_TELL = (
    r"((cannot|difficult to|impossible to|not possible to)[^.;\n]+(determine|say|rule out)|need more information)"
)
LOOKS_SOUND = r"appears to be[^.;\n,]+" + SOUND_ADJECTIVE
ECHOED_QUESTION = r"please answer yes or no"

END = "\x00"
STEMS = (
    "bug", "cwe", "issue", "flaw", "vulnerab", "overflow", "leak", "race", "after", "segmentation", "behavior", "crash",
)
ADJECTIVES = (
    "correct", "fine", "bug-free", "well-", "valid", "functioning as intended", "safe", "secure", "straightforward",
)

# The start of a sentence's match. Anchoring it to a sentence start, or to where the last match ended,
# finds the same matches as an open prefix would, without trying every character as a start.
LEAD = r"(?:\G|(?<![^.;,\n]))[^.;,\n]*"

# Rules for "vulnerable", then for "not vulnerable", then the late ones.
VULNERABLE_RULES = (
    ("yes", r"\byes(, |\.|\n|$)", (), ("yes, ", "yes.", "yes\n", "yes" + END)),
    (
        "has_weakness",
        LEAD + r"\b(contains(?! (no|none|the function))"
        r"|\b(could|can)\b(?! (not))[^.;\n]+(cause|lead to|result in)"
        r"|will result in|point out|has|does have|which is a(?! (good practice))"
        r"|(?<!(if) )there is(?! (no|none))|(?<!(if) )there are(?! (no|none)))\b[^.;,\n]+" + WEAKNESS,
        (DENIES_WEAKNESS, CANNOT_TELL),
        STEMS,
    ),
    (
        "is_weak",
        LEAD + r"\b(appears to be|(function|code|snippet|`) is(?! (not|also not|no|none)|"
        + SOUND_ADJECTIVE
        + r"))\b[^.;\n,]+"
        + WEAK_ADJECTIVE,
        (LOOKS_SOUND, DENIES_STATE, CANNOT_TELL),
        ("buggy", "vulnerable"),
    ),
    ("can_be_exploited", r"\bcan be (exploited|fixed)\b", (), ("can be exploited", "can be fixed")),
    ("will_not_free", r"will not[^.;\n,]+(free)[^.;\n,]+memory", (), ("will not",)),
    ("not_cleaned_up", r"memory[^.;\n,]+will not[^.;\n,]+(cleaned up)", (), ("cleaned up",)),
    ("will_fail", r"(function|code|snippet|`) will fail", (), ("will fail",)),
    ("answer_yes", r"answer: yes", (), ("answer: yes",)),
)
SOUND_RULES = (
    ("no", LEAD + r"\bno(, |\.|\n|$)", (ECHOED_QUESTION,), ("no, ", "no.", "no\n", "no" + END)),
    ("is_sound", r"\b(appears to be|is) " + SOUND_ADJECTIVE, (), ADJECTIVES),
    (
        "lacks_weakness",
        r"\b(does not|do not|don't|doesn't|has no|is not(?! possible to determine)"
        r"|isn't(?! possible to determine)|there are no|contains none of|contains no|cannot detect)\b[^.;,\n]+"
        + WEAKNESS,
        (),
        STEMS,
    ),
    ("answer_no", r"answer: no", (), ("answer: no",)),
)
LATE_VULNERABLE_RULES = (
    ("leading_id", r"^(- |[0-9]+\.)?cwe-", (), ("cwe-",)),
    ("types_present", r"the vulnerability types present are", (), ("the vulnerability types present are",)),
)

# The substrings of the simple verdict, tried in this order.
SIMPLE_YES = ("yes", "is vulnerable", "true")
SIMPLE_NO = ("no", "is not vulnerable", "false")

# What ends an answer, by family; the text before the first of them is kept.
ANSWER_ENDS = {
    "openai": (),
    "starcoder": ("Human:", "\n\n", "-----"),
    "wizardcoder": ("<|endoftext|>", "### Instruction:"),
    "llama": ("</s>",),
    "mistral": ("</s>",),
    "starchat": ("<|end|>",),
}
# Fixed values: (part of a model's name, family), first hit wins.
ANSWER_FAMILIES = (
    ("openai", "openai"),
    ("starcoder", "starcoder"),
    ("WizardCoder", "wizardcoder"),
    ("CodeLlama", "llama"),
    ("deepseek-coder", "llama"),
    ("Mistral", "mistral"),
    ("starchat", "starchat"),
    ("gpt", "openai"),
)
FENCE = "\n```"
FENCE_OPENER = r"\n```[a-z]+\n"
QUESTION, QUESTION_HEAD = "Question", "Question:"
REASONING, ANSWER_HEAD = "reasoning:", "answer:"
IMPROVABLE = "can be improved"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
