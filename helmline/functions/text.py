"""Row-local text expressions. Column in, Column out; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0B\u0085\p{Z}]"
NOT_SPACE = r"[^\s\x0B\u0085\p{Z}]"
_TRIM = rf"\A{SPACE}+|{SPACE}+\z"
_PUNCT_TRIM = r"\A[\p{P} ]+|[\p{P} ]+\z"
_TOKEN = r"[\p{L}\p{Nd}](?:[\p{L}\p{Nd}_\-/.]*[\p{L}\p{Nd}])?"
_SENTENCE = r'[^\n]*?(?:\n|[.!?][.!?")]*(?:[ \t]+|(?=\n)))|[^\n]+\z'
FENCE = "```"

# Words allowed before a directive marker without being the sentence's subject.
PRE_SUBJECT_WORDS = (
    "and but or nor yet so also then now again however therefore additionally further furthermore "
    "moreover meanwhile finally instead still currently next first firstly second secondly lastly "
    "otherwise besides please kindly you your yours yourself i me my we us our must should shall will "
    "would can could may might need do does did to be let the a an just ever not no only always never"
).split()

# Function words dropped from a content key.
CLOSED_CLASS_WORDS = (
    "a an the this that these those i me my mine we us our ours you your yours it its he she they them "
    "their theirs there here is are was were be been being am do does did doing done have has had having "
    "will would shall should can could may might must need let and or but nor so yet if then than as "
    "because while when where which who whom what how why to of in on at by for with from into onto over "
    "under about up down out off again any all some each every more most other such very too also just "
    "now still please make sure get got"
).split()

# Words that flip a requirement's polarity, collapsed to one token in a content key.
NEGATION_WORDS = (
    "not no never nor without avoid cannot cant dont don doesn didn isn aren wasn weren won wouldn "
    "shouldn couldn hasn hadn haven mustn shan"
).split()
NEGATION_TOKEN = "\x00not"


def _words(words):
    return F.array(*[F.lit(w) for w in words])


def lower(c: Column) -> Column:
    """Per-code-point lower case: no context-sensitive sigma, one code point for the dotted I."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def n_bytes(c: Column) -> Column:
    return F.octet_length(c)


def n_chars(c: Column) -> Column:
    return F.length(c)


def n_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(NOT_SPACE + "+"), F.lit(0)))


def n_lines(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(
        F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    )


def lines(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n", -1))


def normalize(c: Column) -> Column:
    """Canonical comparison form: folded, whitespace collapsed, surrounding punctuation trimmed."""
    flat = F.regexp_replace(lower(c), SPACE + "+", " ")
    return F.regexp_replace(flat, _PUNCT_TRIM, "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(lower(c), F.lit(_TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| over distinct token arrays; no evidence gives 0."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def shared_tokens(have: Column, want: Column) -> Column:
    return F.size(F.array_intersect(want, have))


def token_coverage(have: Column, want: Column) -> Column:
    """Fraction of `want` found in `have`."""
    return F.when(F.size(want) == 0, F.lit(0.0)).otherwise(
        shared_tokens(have, want) / F.size(want)
    )


def quoted_chars(c: Column) -> Column:
    """Characters in fences (markers included), quote-prefixed lines and paired backtick spans."""
    walked = F.transform(
        lines(c),
        lambda ln: F.struct(ln.alias("raw"), trim(ln).alias("head")),
    )

    def step(acc, ln):
        marker = ln["head"].startswith(FENCE)
        whole = acc["fence"] | marker | ln["head"].startswith(">")
        inline = F.array_join(F.regexp_extract_all(ln["raw"], F.lit("`[^`]*`"), F.lit(0)), "")
        return F.struct(
            F.when(marker, ~acc["fence"]).otherwise(acc["fence"]).alias("fence"),
            (acc["n"] + F.when(whole, F.length(ln["raw"])).otherwise(F.length(inline))).alias("n"),
        )

    init = F.struct(F.lit(False).alias("fence"), F.lit(0).alias("n"))
    full = F.aggregate(walked, init, step, lambda acc: acc["n"])
    # Texts without a marker of any kind need no line walk.
    return F.when(c.contains("`") | c.contains(">"), full).otherwise(F.lit(0))


def emitted(items: Column, init: Column, step, item: str) -> Column:
    """What a walk over an array emits: `step(acc, x)` appends to the field `out` (entries of type `item`) of its state.

    An append copies the array it appends to. The walk therefore goes in blocks of the square root of the array's
    length, each with an `out` of its own, so that a text of very many spans costs little more per span than a short one.
    """
    none = F.array().cast(f"array<{item}>")

    def block(acc, part):
        return F.struct(
            F.aggregate(part, acc["last"].withField("out", none), step).alias("last"),
            F.concat(acc["done"], F.array(acc["last"]["out"])).alias("done"),
        )

    def walk(xs):
        size = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), size)
        start = F.struct(init.alias("last"), F.array().cast(f"array<array<{item}>>").alias("done"))
        return F.aggregate(
            F.transform(starts, lambda i: F.slice(xs, i, size)), start, block,
            lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]["out"]))),
        )

    # The array around the items binds them once; every block would evaluate them anew otherwise.
    return F.transform(F.array(items), walk)[0]


def sentences(c: Column) -> Column:
    """Spans that tile the text: array<struct<pos,start,end,chars,text,contained>>.

    `start`/`end` are byte offsets, `chars` counts code points of the whole span, `text` is the
    trimmed sentence. `contained` says that the span starts inside a fence or a quoted line. A span
    never crosses a line end, so the state of its line decides.
    """
    spans = F.transform(
        F.regexp_extract_all(c, F.lit(_SENTENCE), F.lit(0)),
        lambda s: F.struct(s.alias("raw"), trim(s).alias("head")),
    )
    item = "struct<pos:int,start:int,end:int,chars:int,text:string,contained:boolean>"
    init = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(True).alias("bol"), F.lit(False).alias("fence"),
        F.lit(False).alias("inside"), F.array().cast(f"array<{item}>").alias("out"),
    )

    def step(acc, s):
        head, raw = s["head"], s["raw"]
        marker = acc["bol"] & head.startswith(FENCE)
        fence = F.when(marker, ~acc["fence"]).otherwise(acc["fence"])
        inside = F.when(
            acc["bol"], acc["fence"] | marker | head.startswith(">")
        ).otherwise(acc["inside"])
        end = acc["at"] + F.octet_length(raw)
        item = F.struct(
            acc["n"].alias("pos"), acc["at"].alias("start"), end.alias("end"),
            F.length(raw).alias("chars"), head.alias("text"), inside.alias("contained"),
        )
        return F.struct(
            (acc["n"] + 1).alias("n"), end.alias("at"), raw.endswith("\n").alias("bol"), fence.alias("fence"),
            inside.alias("inside"), F.concat(acc["out"], F.array(item)).alias("out"),
        )

    return emitted(spans, init, step, item)


def first_sentence(c: Column) -> Column:
    return trim(F.regexp_extract(c, r"\A(?:" + _SENTENCE + ")", 0))


def content_key(c: Column) -> Column:
    """Content tokens with polarity, deduplicated and sorted; empty when nothing is left."""
    return content_key_of(token_set(c))


def content_key_of(toks: Column) -> Column:
    dropped = set(CLOSED_CLASS_WORDS) | set(NEGATION_WORDS)
    content = F.array_except(
        F.filter(toks, lambda t: F.octet_length(t) >= 2), _words(sorted(dropped))
    )
    negated = F.arrays_overlap(toks, _words(NEGATION_WORDS))
    body = F.array_join(F.array_sort(content), " ")
    return F.when(F.size(content) == 0, "").otherwise(
        F.concat(F.when(negated, NEGATION_TOKEN + " ").otherwise(""), body)
    )


def has_subject(prefix: Column) -> Column:
    """True when some token before the marker is not a word that may precede a directive."""
    return F.size(F.array_except(tokens(prefix), _words(PRE_SUBJECT_WORDS))) > 0


def code_density(c: Column, span_pattern: str, path_pattern: str) -> Column:
    """Share of characters inside backtick spans or path tokens, overlaps counted once.

    Each pattern turns the text into a mask of its own length, and the masks are merged by position.
    """
    def marked(pattern):
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        gaps = F.split(c, pattern, -1)
        walk = F.zip_with(
            gaps, found,
            lambda g, m: F.concat(
                F.repeat(F.lit("0"), F.length(F.coalesce(g, F.lit("")))),
                F.repeat(F.lit("1"), F.length(F.coalesce(m, F.lit("")))),
            ),
        )
        return F.array_join(walk, "")

    both = F.zip_with(
        F.split(marked(span_pattern), ""), F.split(marked(path_pattern), ""),
        lambda a, b: F.when((a == "1") | (b == "1"), 1).otherwise(0),
    )
    covered = F.aggregate(both, F.lit(0), lambda s, x: s + x)
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(covered / F.length(c))


def normalize_target(root: Column, path: Column) -> Column:
    """Path relative to the root when it lies under it; kept absolute outside of it."""
    p, r = clean_path(path), clean_path(root)
    return (
        F.when(path == "", "")
        .when((F.coalesce(root, F.lit("")) == "") | ~p.startswith("/"), p)
        .when(p == r, ".")
        .when(p.startswith(F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2))
        .otherwise(p)
    )


def clean_path(path: Column) -> Column:
    """Lexical clean-up: empty and dot segments dropped, parent segments applied."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/", -1), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        can_pop = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last).otherwise("") != "..")
        return (
            F.when(s != "..", F.concat(acc, F.array(s)))
            .when(can_pop, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(rooted, acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    walked = F.array_join(F.aggregate(parts, empty, step), "/")
    simple = ~path.rlike(r"//|(^|/)\.{1,2}(/|$)|.+/$")
    return (
        F.when(path == "", ".")
        .when(simple, path)
        .when(rooted, F.concat(F.lit("/"), walked))
        .when(walked == "", ".")
        .otherwise(walked)
    )


def without_first(text: Column, part: Column) -> Column:
    """The text with the first occurrence of a part of it replaced by a space."""
    at = F.position(part, text)
    return F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "),
                    F.substring(text, at + F.length(part), F.length(text)))
