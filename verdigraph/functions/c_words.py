"""Fixed values of the C language: its keywords, type words and token forms."""

# Keywords that are neither types nor names.
KEYWORDS = (
    "break", "case", "continue", "default", "do", "else", "for", "goto", "if", "return",
    "sizeof", "switch", "while", "NULL", "true", "false",
)
# Words a type is written with.
TYPE_WORDS = (
    "auto", "bool", "char", "const", "double", "enum", "extern", "float", "inline", "int", "long",
    "register", "restrict", "short", "signed", "size_t", "ssize_t", "static", "struct", "typedef",
    "union", "unsigned", "void", "volatile",
)
# Type words that are a whole type on their own.
PRIMITIVE_TYPES = ("bool", "char", "double", "float", "int", "size_t", "ssize_t", "void")
# Type words followed by a tag name.
TAGGED_TYPES = ("struct", "union", "enum")

# One token per match, longest operators first.
STRING = r'"(?:[^\\"]|\\.)*"'
CHAR = r"'(?:[^\\']|\\.)*'"
NAME = r"[A-Za-z_][A-Za-z0-9_]*"
NUMBER = r"\.?[0-9](?:[eEpP][+-]|[A-Za-z0-9_.])*"
OPERATOR = r"<<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]="
# Operators that assign.
ASSIGNING = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=")
STEPPING = ("++", "--")
MEMBER = (".", "->")
