"""Fixed values of prompts: every text that must read exactly so."""

# Texts of the question, its answers and the system turn.
SYSTEM = "You are a code security expert who excels at detecting vulnerabilities. "
QUESTION = "Is the following function vulnerable? Please answer Yes or No."
ANSWERS = ("No, the function is not vulnerable.", "Yes, the function is vulnerable.")

# Context kinds and the label each gets inside the prompt's comment.
CONTEXT_LABELS = {"data_flow": "Data flow", "api_call": "API call"}

# Closers after a cut, and the step-by-step line.
QUOTES = "'''"
COMMENT_END = "*/"
COT = "Let's think step by step."

# Fixed values: (part of a model's name, chat family), first hit wins.
CHAT_FAMILIES = (
    ("CodeLlama", "llama"),
    ("deepseek-coder", "deepseek"),
    ("Mistral", "mistral"),
    ("starchat-beta", "starchat"),
    ("WizardCoder", "wizardcoder"),
    ("gpt", "gpt"),
)

# Per family the texts around the system turn, around the user turn, the tail of a
# truncated turn, the step-by-step line as appended, and what surrounds the whole.
LAYOUTS = {
    "gpt": {"system": ("", ""), "user": ("", ""), "cut": "\n'''\n", "cot": COT + "\n\n", "whole": ("", "")},
    "wizardcoder": {
        "system": ("", "\n\n"), "user": ("### Instruction:\n", "\n"),
        "cut": "\n'''\n", "cot": COT + "\n\n", "whole": ("", "### Response:\n"),
    },
    "deepseek": {
        "system": ("", "\n"), "user": ("### Instruction:\n", "\n"),
        "cut": "\n'''\n", "cot": COT + "\n", "whole": ("", "### Response:\n"),
    },
    "mistral": {
        "system": ("", "\n\n"), "user": ("", ""),
        "cut": "\n'''", "cot": "\n" + COT, "whole": ("<s>[INST] ", " [/INST]"),
    },
    "llama": {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("", ""),
        "cut": "\n'''", "cot": "\n" + COT, "whole": ("[INST] ", " [/INST]"),
    },
    "starchat": {
        "system": ("<|system|>\n", "<|end|>\n"), "user": ("<|user|>\n", "<|end|>\n"),
        "cut": "\n'''", "cot": "\n" + COT, "whole": ("", "<|assistant|>"),
    },
}
