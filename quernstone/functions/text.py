"""Scalar text functions as Catalyst expressions. Columns in, columns out; nothing here runs Python on rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOPWORDS = frozenset(
    "a add all an and as at be by can code do does fix for from function get how i in into is it make method of on or set should that the this to use using via we what when where with".split()
)
LANGUAGES = {
    "rust": "rs", "python": "py pyi pyw", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "java": "java", "c": "c h",
    "cpp": "cc cpp cxx c++ hpp hh hxx h++ ipp tpp", "csharp": "cs", "ruby": "rb rake gemspec", "php": "php php5 php7 phtml", "swift": "swift", "dart": "dart",
}
EXTENSIONS = {e: lang for lang, es in LANGUAGES.items() for e in es.split()}


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(c, UPPER, LOWER)


def line_count(text: Column) -> Column:
    """Lines; a final newline begins none, and an empty text has none."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def language_of(path: Column) -> Column:
    """Language id of a path by its extension, case ignored; other if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [x for e, lang in EXTENSIONS.items() for x in (F.lit(e), F.lit(lang))]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("other"))


def count_of(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)


def path_score(path: Column) -> Column:
    """Depth, test and generated-code penalties of a path."""
    low = F.lower(path)
    tests = low.contains("test") | low.contains(".spec.")
    made = low.contains("/vendor/") | low.contains("/generated/") | low.contains(".min.")
    return -0.05 * count_of(path, "/") - F.when(tests, 1.0).otherwise(0.0) - F.when(made, 1.5).otherwise(0.0)


def split_identifier(name: Column) -> Column:
    """Lower-case parts of an identifier: cut at _, -, blanks, and where a capital follows a small letter or digit."""
    cut = F.regexp_replace(name, r"(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})", "_")
    return F.filter(F.transform(F.split(cut, r"[_\- ]+"), F.lower), lambda x: x != "")


def acronym(name: Column) -> Column:
    return F.array_join(F.transform(split_identifier(name), lambda x: F.substring(x, 1, 1)), "")


def subsequence(name: Column, needle: str) -> Column:
    """Whether the needle's characters stand in this order in name."""
    return name.rlike("(?s)" + ".*".join(re.escape(c) for c in needle)) if needle else F.lit(True)


def fuzzy_score(name: Column, needle: str) -> Column:
    """100 equal, 70 prefix, 60 acronym, 50 substring, 30 subsequence, else null; ASCII case ignored."""
    n, low = needle.lower(), ascii_lower(name)
    return F.when(low == n, 100.0).when(low.startswith(n), 70.0).when(acronym(name) == n, 60.0).when(low.contains(n), 50.0).when(subsequence(low, n), 30.0)


def est_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def task_terms(task: str) -> list[str]:
    """Distinct terms of a task in order of first occurrence."""
    out: list[str] = []
    for word in re.split(r"[^\w]+", task):
        for part in re.split(r"[_\- ]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", word)):
            t = part.lower()
            if len(t.encode()) >= 2 and t not in STOPWORDS and t not in out:
                out.append(t)
    return out


#: Kinds of definitions that stand for a whole piece of code.
PRIORITY_KINDS = ("class", "constructor", "enum", "function", "interface", "method", "module", "struct", "trait", "type")


def lexical_score(name: Column, kind: Column, signature: Column, container: Column, path: Column, terms: list[str]) -> Column:
    """Sum over terms of 20 equal name, 12 part of it, 6 substring; 4 container part, 3 signature, 2 path; 2 for a main kind."""
    total = F.lit(0.0)
    low, parts, held = ascii_lower(name), split_identifier(name), split_identifier(F.coalesce(container, F.lit("")))
    for t in terms:
        total = total + F.when(low == t, 20.0).when(F.array_contains(parts, t), 12.0).when(low.contains(t), 6.0).otherwise(0.0)
        total = total + F.when(F.array_contains(held, t), 4.0).otherwise(0.0)
        total = total + F.when(ascii_lower(F.coalesce(signature, F.lit(""))).contains(t), 3.0).otherwise(0.0)
        total = total + F.when(ascii_lower(path).contains(t), 2.0).otherwise(0.0)
    return total + F.when((total > 0) & kind.isin(*PRIORITY_KINDS), 2.0).otherwise(0.0)


def stem(word: Column) -> Column:
    """First fitting suffix of ing, ed, es, s removed, if the word is long enough in bytes."""
    n, out = F.octet_length(word), word
    cases = F.when(word.endswith("ing") & (n >= 4), F.substring(word, 1, F.length(word) - 3))
    for suffix, least in (("ed", 3), ("es", 3), ("s", 4)):
        cases = cases.when(word.endswith(suffix) & (n >= least), F.substring(word, 1, F.length(word) - len(suffix)))
    return cases.otherwise(out)


_CASE_BREAK = r"(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})"


def semantic_tokens(text: Column) -> Column:
    """Of each word of letters, digits and _: its parts, cut at _ and at changes of case, then the word itself, in lower case.

    Tokens of one byte are left out; a word of one part counts twice. Breaks of case are marked in the whole text first,
    so that only words that have one are cut.
    """
    words = F.filter(F.split(F.regexp_replace(text, _CASE_BREAK, "\x01"), r"[^\p{L}\p{N}_\x01]+"), lambda w: w != "")
    return F.filter(F.flatten(F.transform(words, _parts_and_whole)), lambda p: F.octet_length(p) >= 2)


def _parts_and_whole(marked: Column) -> Column:
    low = F.lower(marked)
    cut = F.concat(F.split(low, "[_\x01]"), F.array(F.replace(low, F.lit("\x01"), F.lit(""))))
    return F.when(low.contains("_") | low.contains("\x01"), cut).otherwise(F.array(low, low))


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of a text of at most so many bytes, cut at a character."""
    raw = F.encode(text, "UTF-8")
    h = F.hex(F.substring(raw, 1, most + 1))
    inside = lambda n: F.substring(h, 2 * n + 1, 1).isin("8", "9", "A", "B")  # noqa: E731  byte n + 1 goes on with a character
    n = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), n).cast("string"))


def display(line: Column, most: int = 320) -> Column:
    """The line without blanks at its end; past so many bytes it is cut at a character and gets an ellipsis."""
    r = F.regexp_replace(line, r"\s+\z", "")
    return F.when(F.octet_length(r) <= most, r).otherwise(F.concat(cut_bytes(r, most), F.lit("…")))


def signature(line: Column) -> Column:
    """First line of a definition: trimmed, without a final brace, 200 bytes at most."""
    return cut_bytes(F.rtrim(F.regexp_replace(F.trim(line), r"\{$", "")), 200)


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading parts of two paths, the file's name included."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: p.isNotNull() & q.isNotNull() & (p == q))
    stop = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.lit(False))
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


#: Folders that say nothing about what the code in them is for.
STRUCTURAL_DIRS = frozenset("__mocks__ __tests__ app apps assets build common component components controller controllers core data demo dist example examples fixtures gen generated handler handlers helper helpers i18n include includes internal lib libs locale locales main middleware middlewares migrations mocks model models module modules node_modules out packages pkg public report reports router routes security service services shared spec specs src static target test tests util utils vendor view views wizard wizards".split())
#: Files that are named for their folder.
BARE_NAMES = frozenset("index mod __init__ main lib".split())


def path_tokens(path: Column) -> Column:
    """Tokens of the telling components of a path without its extension: folders but the structural ones, and the file."""
    parts = F.split(F.when(path.contains("."), F.regexp_extract(path, r"(?s)^(.*)\.", 1)).otherwise(path), "/")
    file = F.element_at(parts, -1)
    folders = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: ~ascii_lower(p).isin(*sorted(STRUCTURAL_DIRS)))
    telling = F.concat(folders, F.filter(F.array(file), lambda p: ~ascii_lower(p).isin(*sorted(BARE_NAMES))))
    marked = F.transform(telling, lambda p: F.regexp_replace(p, _CASE_BREAK, "\x01"))
    return F.filter(F.flatten(F.transform(marked, _parts_and_whole)), lambda t: F.octet_length(t) >= 2)


#: (penalty, pieces of a lower-case path of which any counts, its endings, beginnings of its file).
NOISE = (
    (0.040, ("/test", "test/", "__tests__", ".test.", ".spec.", "/spec/"), (), ()),
    (0.012, ("/compat/", "/examples/", "/legacy/"), (), ()),
    (0.016, ("/lib/", "/vendor/", ".min."), (".d.ts",), ()),
    (0.010, ("/static/",), (".css",), ()),
    (0.045, ("/i18n/",), (".po", ".pot"), ()),
    (0.050, ("/doc/", "/docs/", "/documentation/", "/readme", "/website/"), (".adoc", ".markdown", ".md", ".mdown", ".mdx", ".rdoc", ".rst", ".txt"), ()),
    (0.022, (), (".cfg", ".csv", ".ini", ".toml", ".xml", ".yaml", ".yml"), ()),
    (0.030, (), (), ("authors", "changelog", "copying", "license", "notice")),
)


def noise_penalty(path: Column) -> Column:
    """What tests, examples, vendored and generated code, catalogs, prose, data and legal files lose in a ranking."""
    low, total = ascii_lower(path), F.lit(0.0)
    file = F.substring_index(low, "/", -1)
    for amount, pieces, endings, beginnings in NOISE:
        hit = F.lit(False)
        for test in [*map(low.contains, pieces), *map(low.endswith, endings), *map(file.startswith, beginnings)]:
            hit = hit | test
        total = total + F.when(hit, amount).otherwise(0.0)
    return total


def is_symbol_like(query: str) -> bool:
    q = query.strip()
    return bool(q) and not re.search(r"\s", q) and ("_" in q or "::" in q or "." in q or (q != q.lower() and q != q.upper()))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 12)
