"""Text functions as Catalyst expressions: folding, terms, identifiers, codes, safety scans, redaction."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (word lists, patterns and markers that results depend on).
STOPWORDS = ["a", "as", "com", "da", "de", "do", "e", "em", "o", "os", "qual", "quais", "que", "tem", "para", "por", "um", "uma"]
INTENT_TERMS = {
    "service_price": ["preco", "precos", "valor", "valores", "custa", "custam", "servico", "servicos"],
    "business_hours": ["horario", "horarios", "abre", "fecha", "segunda", "sabado", "domingo"],
    "discount_rule": ["desconto", "pix", "promocao"],
    "payment_method": ["pagamento", "pix", "cartao", "dinheiro"],
    "contact_info": ["telefone", "contato", "email", "endereco"],
    "faq_item": ["como", "duvida", "pergunta"],
}
SENSITIVE_TOKENS = ["cost", "custo", "margin", "margem", "secret", "token", "credential"]
SENSITIVE_PHRASES = ["supplier_price", "internal_notes", "api_key"]
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"ignore\s+(all\s+)?prior\s+instructions?",
    r"disregard\s+(your\s+)?(previous\s+)?instructions?",
    r"you\s+are\s+now\s+a",
    r"act\s+as\s+(if\s+you\s+(are|were)\s+)?a",
    r"new\s+instructions?:",
    r"system\s*:\s*ignore",
    r"<\s*/?system\s*>",
    r"prompt\s*injection",
    r"jailbreak",
    r"ignore\s+as\s+instruções\s+anteriores",
    r"desconsidere\s+as\s+instruções",
    r"novas\s+instruções\s*:",
    r"você\s+agora\s+é",
    r"finja\s+ser",
    r"aja\s+como",
    r"esqueça\s+(tudo|as\s+instruções)",
    r"a\s+partir\s+de\s+agora\s+você\s+é",
    r"novo\s+papel\s*:",
    r"instrução\s+do\s+sistema\s*:",
]
FORBIDDEN_MARKERS = ["raw_prompt", "provider_response", "SYSTEM PROMPT", "system prompt", "Traceback", "X-Amz-Signature", "password="]
TOKEN_PATTERNS = [
    r"\bBearer\s+[A-Za-z0-9._~+/=-]+",
    r"\b(?:sk|pk|rk|sb|org|proj)-[A-Za-z0-9_-]{16,}\b",
    r"\b[A-Za-z]:(?:\\|\\\\)+(?:Users|Documents and Settings)(?:\\|\\\\)+[^\s,;)]*",
    r"(?<![A-Za-z0-9])/(?:Users|home|root)/[^\s,;)]*",
]
STATUS_ALIASES = {
    "VIGENT": "vigent", "VIGENTE": "vigent", "ACTIVE": "vigent", "OBSOLETE": "obsolete", "OBSOLETO": "obsolete", "DEPRECATED": "obsolete",
    "DRAFT": "draft", "RASCUNHO": "draft", "APPROVED": "approved", "APROVADO": "approved", "UNKNOWN": "unknown", "DESCONHECIDO": "unknown",
}
QUOTE_LETTERS = ("‘’‚‛′“”„‟″«»", "'''''\"\"\"\"\"\"\"")

#: What Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

ALL_INTENT_TERMS = sorted({x for terms in INTENT_TERMS.values() for x in terms})


def _folds() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one plain letter and marks, and those letters."""
    pairs = []
    for k in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(k):
            pairs.append((chr(k), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKS = "".join(map(chr, range(0x300, 0x370)))
ACCENTED, PLAIN = _folds()


def _compositions() -> list[tuple[str, str]]:
    """Latin letters with their canonical decomposition, longer ones first."""
    letters = [chr(k) for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(unicodedata.normalize("NFD", c), c) for c in letters]
    return sorted([(a, b) for a, b in pairs if a != b and unicodedata.normalize("NFC", a) == b], key=lambda p: (-len(p[0]), p))


COMPOSITIONS = _compositions()


def composed(text: Column) -> Column:
    """Latin letters and their marks as one character each; a text without marks is only searched for them."""
    pairs = F.from_json(F.lit(json.dumps(COMPOSITIONS)), "array<array<string>>")
    return F.when(text.rlike("[\\x{300}-\\x{36f}]"), F.aggregate(pairs, text, lambda t, p: F.replace(t, p[0], p[1]))).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it: expressions are written out where they are used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))  # looks at the ends only, which a regular expression does not


def fold(text: Column) -> Column:
    """Lower case without accents, of whole letters or of letters and marks."""
    return F.translate(F.lower(text), ACCENTED + MARKS, PLAIN)  # what has no counterpart is dropped


def fold_value(text: Column) -> Column:
    """``fold`` of a column: it costs a look at each sign, so signs of ASCII alone are only put in lower case."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), fold(text)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of the folded text."""
    return F.filter(F.split(fold(text), "[^a-zA-Z0-9_]+"), lambda x: x != "")


def terms(text: Column) -> Column:
    """Distinct words of three letters or more that are no stop-words, in order."""
    return F.array_distinct(F.filter(words(text), lambda x: (F.length(x) >= 3) & ~x.isin(STOPWORDS)))


def literals(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def entity_terms(found: Column) -> Column:
    return F.array_except(found, literals(ALL_INTENT_TERMS))


def intent_matched(kind: Column, found: Column) -> Column:
    """Whether the terms meet the vocabulary of a record's kind."""
    out = F.lit(False)
    for name, vocabulary in INTENT_TERMS.items():
        out = out | ((kind == name) & F.arrays_overlap(found, literals(vocabulary)))
    return F.coalesce(out, F.lit(False))


def identifier(text: Column) -> Column:
    """camelCase and any separators as snake_case, folded."""
    parted = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.regexp_replace(F.regexp_replace(fold(parted), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _sensitive_hint() -> str:
    parts = [*SENSITIVE_TOKENS, *[x.split("_")[0] for x in SENSITIVE_PHRASES]]
    heads = "|".join(f"{c}(?:{'|'.join(sorted({x[1:] for x in parts if x[0] == c}))})" for c in sorted({x[0] for x in parts}))
    apart = "|".join("[^a-z0-9]*".join(x.replace("_", "")) for x in SENSITIVE_PHRASES)  # a line that is a phrase letter by letter
    return f"{heads}|^[^a-z0-9]*+(?:{apart})[^a-z0-9]*$"


#: What every folded text has whose identifier names something sensitive; one pass tells which texts need to be made identifiers.
SENSITIVE_HINT = _sensitive_hint()


def names_sensitive(ident: Column) -> Column:
    """Whether an identifier holds a sensitive word, or is or holds a sensitive phrase."""

    def named_in(x: Column) -> Column:
        hit = F.arrays_overlap(F.split(x, "_"), literals(SENSITIVE_TOKENS))
        compact = F.replace(x, F.lit("_"), F.lit(""))
        for phrase in SENSITIVE_PHRASES:
            hit = hit | F.contains(x, F.lit(phrase)) | (compact == phrase.replace("_", ""))
        return hit

    return let(ident, named_in)


def public_quote(text: Column) -> Column:
    """The text, or null if it names something sensitive."""
    return F.when(~names_sensitive(identifier(text)), text)


def injection_matches(text: Column) -> Column:
    """The injection patterns that a text matches, in order; cases of accented letters count as equal."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?iu)" + p), F.lit(p)) for p in INJECTION_PATTERNS]))


def redacted(text: Column) -> Column:
    """Tokens, private paths and forbidden markers replaced by ``[redacted]``."""
    for pattern in TOKEN_PATTERNS:
        text = F.regexp_replace(text, "(?i)" + pattern, "[redacted]")
    for marker in FORBIDDEN_MARKERS:
        text = F.replace(text, F.lit(marker), F.lit("[redacted]"))
    return text


def forbidden(text: Column) -> Column:
    """Names of the forbidden markers and patterns in a text."""
    marks = [F.when(F.contains(text, F.lit(m)), F.lit(f"forbidden_marker:{m}")) for m in FORBIDDEN_MARKERS]
    shapes = [F.when(text.rlike("(?i)" + p), F.lit(f"forbidden_pattern:{p}")) for p in TOKEN_PATTERNS]
    return F.array_compact(F.array(*marks, *shapes))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_slug(name: Column) -> Column:
    """Slug of a file name without its suffix and leading number."""
    return slug(F.regexp_replace(F.regexp_replace(name, r"\.[^./]*$", ""), r"^\d+_", ""))


def document_code(text: Column) -> Column:
    code = F.regexp_replace(F.upper(trimmed(text)), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(code, "-+", "-"), "^-+|-+$", "")


def revision(text: Column) -> Column:
    """Upper case without the word or letter for revision in front."""
    return trimmed(F.regexp_replace(F.upper(trimmed(text)), r"^(?:REV(?:ISAO|ISÃO)?\.?|R)\s*[-:.]?\s*", ""))


def named(names: dict[str, str]) -> Column:
    """A literal map, to look a value up in once instead of asking for each of its keys."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def document_status(text: Column) -> Column:
    return F.coalesce(F.element_at(named(STATUS_ALIASES), F.upper(trimmed(text))), F.lower(trimmed(text)))


def canonical_quote(text: Column) -> Column:
    """Letters composed, one kind of quotation mark, white space collapsed and trimmed."""
    straight = F.translate(composed(text), *QUOTE_LETTERS)
    return F.trim(F.regexp_replace(straight, r"(?U)\s+", " "))


def section_path(label: Column) -> Column:
    """``1.2.3`` as ``1/1.2/1.2.3``."""
    parts = F.split(label, r"\.")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".")), "/")


def boilerplate_key(line: Column) -> Column:
    """Lower case, white space collapsed, runs of digits as ``#``."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"\s+", " "))), r"\d+", "#")


def is_heading(line: Column) -> Column:
    """Begins with ``#``, or is short, in capitals and has a letter."""
    capital = (F.length(line) <= 60) & (F.upper(line) == line) & (F.lower(line) != line)
    return line.startswith("#") | capital


def split_values(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[;|,]"), lambda x: F.trim(x)), lambda x: x != "")


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences of a part, overlapping ones included; none of an empty part."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(part) + 1, F.lit(1)))
    counted = F.size(F.filter(at, lambda k: F.substr(text, k, F.length(part)) == part))
    return F.when((F.length(part) == 0) | ~F.contains(text, part), 0).otherwise(counted)


def fitted(text: Column, max_tokens: int) -> Column:
    """Cut to about so many tokens of four characters, with an ellipsis."""
    cut = F.concat(F.regexp_replace(F.substring(text, 1, max(0, 4 * max_tokens - 3)), r"\s+$", ""), F.lit("..."))
    return F.when(text_tokens(text) <= max_tokens, text).otherwise(F.substring(text, 1, 4) if max_tokens <= 1 else cut)


def text_tokens(text: Column) -> Column:
    """At least one, a token for each four characters begun."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def chunk_tokens(text: Column) -> Column:
    """A token for each four whole characters."""
    return F.floor(F.length(text) / 4).cast("long")
