"""One consistent form for texts that look the same.

A transducer compiled once reads a text once, cluster by cluster, always the longest that it knows: a pictograph sequence
with its joiners, a syllable of conjoining letters, a base with all its marks (and whatever shows nothing between them), or
a run of single characters. Widths, space-like characters, invisible characters and look-alike letters go to one prototype
each, a base with its marks to its canonical composition. Rules are checked for conflicts when compiled: no cluster has two
outputs and every output is its own output, so the form is stable. Case, accents, raised digits, line ends and every
other visible mark are kept.

A null text stays null; a text that shows nothing becomes a text without visible characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import skew_join
from ..runtime import materialise

#: Parts that the documents of one text are spread over when links are expanded.
SALTS = 16

# Letters of other alphabets beside the Latin letters they look like.
LOOKALIKES = {
    "cyrillic": ("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝԍүѵӀѴӏ", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwgyvlVl"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc"),
    "armenian": ("ՕՏԼՍօոսհցզյ", "OSLUonuhgqj"),
    "cherokee": ("ᎪᎫᎬᎳᎷᎻᏀᏃᏚᏞᏟᏢᏦᎠᎡᎢᎩᏂᏏᏙᏧᏴꭵꮁꮃꮓꮩꮪꮯ", "AJEWMHGZSLCPKDRTYhbVdBirwzvsc"),
    "coptic": ("ⲅⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⲽⳐ", "rHIKMNOoPpCcTYXwL"),
    "lisu": ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"),
    "phonetic": ("ɑɡ", "ag"),
}
# Characters outside the format category that show nothing.
SHOW_NOTHING = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2065, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0xFFF0, 0xFFF9), *range(0xE0000, 0xE0100)]


def _rules() -> Iterator[tuple[str, str]]:
    """(cluster, output) of single characters, by class."""
    for n in range(0xFF01, 0xFF5F):  # full width
        yield chr(n), chr(n - 0xFEE0)
    for n in range(0x110000):
        c = chr(n)
        kind = unicodedata.category(c)
        if kind == "Zs" and c != " ":
            yield c, " "
        elif kind == "Cf" or kind == "Cc" and c not in "\t\n\r\v\f\x1c\x1d\x1e\x1f\x85":
            yield c, ""
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")) and not 0xFF01 <= n < 0xFF5F and n not in (0x3000, 0xFFA0):
            yield c, chr(int(unicodedata.decomposition(c).split()[1], 16))  # the ordinary form itself, not what that is made of
    for n in SHOW_NOTHING:
        yield chr(n), ""
    for odd, plain in LOOKALIKES.values():
        for c, p in zip(odd, plain, strict=True):
            yield c, p
    yield "µ", "μ"


def compile_rules() -> dict[int, str]:
    """The table of single code points, closed under composition and checked for conflicts."""
    table: dict[str, str] = {}
    for c, out in _rules():
        if table.get(c, out) != out:
            raise ValueError(f"{c!r} has two outputs")
        table[c] = out
    # Composed letters of a mapped base, and singletons that decompose to another character.
    for n in range(0x110000):
        c = chr(n)
        if c in table or 0xAC00 <= n < 0xD7A4 or not unicodedata.decomposition(c) or unicodedata.decomposition(c)[0] == "<":
            continue
        d = unicodedata.normalize("NFD", c)
        out = unicodedata.normalize("NFC", "".join(table.get(x, x) for x in d))
        if out != c:
            table[c] = out
    for c, out in table.items():
        again = unicodedata.normalize("NFC", "".join(table.get(x, x) for x in out))
        if again != out:
            raise ValueError(f"{c!r} gives {out!r}, which is not stable")
    return {ord(c): out for c, out in table.items()}


def _set(chars: set[int]) -> str:
    """The inside of a character class."""
    out, run = [], []
    for n in [*sorted(chars), -1]:
        if run and n != run[-1] + 1:
            out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
            run = []
        run.append(n)
    return "".join(out)


def pictographs() -> set[int]:
    return {n for n in range(0xA9, 0x20000) if not 0xD800 <= n < 0xE000 and regex.match(r"\p{Extended_Pictographic}", chr(n))}


#: Characters between the clusters that a transducer looks at: printable ASCII and the controls that lay out lines.
PLAIN = "\\t-\\r\x1c-\x1f -~"


class Transducer:
    """Compiled rules; apply() takes one text to its consistent form in one pass."""

    def __init__(self, table: dict[int, str] | None = None) -> None:
        self.rules = compile_rules() if table is None else table
        shown = {n: out for n, out in self.rules.items() if out}
        nothing = _set({n for n, out in self.rules.items() if not out})
        marks = {n for n in range(0x300, 0x110000) if unicodedata.category(chr(n))[0] == "M"} - set(self.rules) | {n for n, out in shown.items() if unicodedata.category(out[0])[0] == "M"}
        mark, any_nothing = _set(marks), f"[{nothing}]*"
        lead, vowel, tail = "\u1100-\u1112", "\u1161-\u1175", "\u11a8-\u11c2"
        picture = f"[{_set(pictographs())}]\ufe0f?[\U0001f3fb-\U0001f3ff]?"
        #: Longest first: pictures with joiners, conjoining letters, a base with its marks, mapped characters.
        self.cluster = re.compile(
            f"({picture}(?:\u200d{picture})+)"
            f"|[{lead}]{any_nothing}[{vowel}](?:{any_nothing}[{tail}])?|[\uac00-\ud7a3]{any_nothing}[{tail}]"
            f"|[^{nothing}{mark}]?(?:{any_nothing}[{mark}])+"
            f"|(?:[{_set(set(self.rules))}](?!{any_nothing}[{mark}]))+"
        )
        #: What the clusters lie in: characters that aren't plain, and the one before them, which may be their base.
        self.odd = re.compile(f"[{PLAIN}]?[^{PLAIN}]+")
        self.memo: dict[str, str] = {}

    def _cluster(self, m: re.Match) -> str:
        text = m.group()
        if m.group(1):  # joiners between pictures change what is shown
            return "\u200d".join(part.translate(self.rules) for part in text.split("\u200d"))
        while True:
            out = unicodedata.normalize("NFC", text.translate(self.rules))
            if out == text:
                return out
            text = out

    def _odd(self, m: re.Match) -> str:
        text = m.group()
        out = self.memo.get(text)
        if out is None:
            out = self.cluster.sub(self._cluster, text)
            if len(self.memo) < 100_000 and len(text) < 100:  # bounds the memory of a task, not the result
                self.memo[text] = out
        return out

    def apply(self, text: str | None) -> str | None:
        if text is None or text.isascii() and text.isprintable():
            return text
        out = self.odd.sub(self._odd, text)
        return text if out == text else out


_own: list[Transducer] = []


def transducer(table: dict[int, str] | None = None) -> Transducer:
    """The process's transducer; workers get the table that the driver compiled."""
    if not _own:
        _own.append(Transducer(table))
    return _own[0]


def form_sql(text: str) -> str:
    """An SQL expression of the same form, in the steps that SQL has: the mapping by characters, then composition, twice."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rules = {chr(n): out for n, out in compile_rules().items() if n}
    single = {c: out for c, out in rules.items() if len(out) == 1}
    gone = "".join(c for c, out in rules.items() if not out)
    picture = re.sub(r"\\U0*([0-9a-f]+)", r"\\x{\1}", _set(pictographs()))
    joined = lambda t: f"regexp_replace({t}, '([{picture}]\ufe0f?[\U0001f3fb-\U0001f3ff]?)\u200d([{picture}])', '\\1\ufdd0\\2', 'g')"
    mapped = lambda t: f"nfc_normalize(translate({t}, {quote(''.join(single) + gone)}, {quote(''.join(single.values()))}))"
    out = joined(joined(text))
    for c, many in rules.items():
        if len(many) > 1:
            out = f"replace({out}, {quote(c)}, {quote(many)})"
    return f"replace({mapped(mapped(out))}, '\ufdd0', '\u200d')"


def canonical_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with every text in its consistent form; narrow."""

    table = transducer().rules

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = transducer(table).apply
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([apply(t) for t in some.column(1).to_pylist()], pa.string())], names=[key, text])

    return df.select(key, text).mapInArrow(run, df.select(key, text).schema)


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stored, form): 128-bit digests of the text as stored and in its consistent form; texts that show nothing are left out."""

    table = transducer().rules

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply, digest = transducer(table).apply, xxhash.xxh3_128_digest
        for b in batches:
            keys, stored, forms = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                form = apply(t)
                if form is None or not form or form.isspace():
                    continue
                keys.append(k)
                stored.append(digest(t.encode()))
                forms.append(stored[-1] if form is t else digest(form.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.types[0]), pa.array(stored, pa.binary()), pa.array(forms, pa.binary())], names=[key, "stored", "form"])

    schema = df.select(key).schema.add("stored", T.BinaryType()).add("form", T.BinaryType())
    return df.select(key, text).mapInArrow(run, schema)


def _kinds(prints: DataFrame, key: str) -> DataFrame:
    """(form, stored, n, first): the different stored texts of each form, with their number of rows and smallest key."""
    return prints.groupBy("form", "stored").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, n_members, n_texts, n_links): one row for each row that shows something; links aren't expanded.

    A class is the rows of one form, named by its smallest key; n_texts is the number of its different stored texts, n_links that of
    its rows stored otherwise than this one. A form that a third of all rows share is met by a broadcast of its own rows.
    Null keys, null texts and texts that show nothing take no part; an empty table gives no rows.
    """
    prints = materialise(fingerprints(df.filter(F.col(key).isNotNull()), key, text), "forms")
    kinds = materialise(_kinds(prints, key), "kinds")
    whole = kinds.groupBy("form").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_members"), F.count(F.lit(1)).alias("n_texts"))
    name = F.hex(F.concat("form", "stored")).alias("__kind")
    sizes = kinds.join(whole, "form").select(name, "class_id", "n_members", "n_texts", (F.col("n_members") - F.col("n")).alias("n_links"))
    return skew_join(prints.select(key, name), sizes, "__kind", 0.01).drop("__kind")


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_a, doc_b), doc_a the smaller key: texts of one form that are stored differently.

    Different stored texts of a form are paired first and documents joined to both sides after, so copies of one
    text are never compared with each other; the documents of a text are spread over SALTS parts. Null keys, null texts and
    texts that show nothing take no part.
    """
    prints = materialise(fingerprints(df.filter(F.col(key).isNotNull()), key, text), "forms")
    kinds = _kinds(prints, key).select("form", "stored")
    mixed = kinds.groupBy("form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("form")
    kinds = materialise(kinds.join(mixed, "form", "left_semi"), "mixed")
    pairs = kinds.withColumnRenamed("stored", "s1").join(kinds.withColumnRenamed("stored", "s2"), "form").filter("s1 < s2")
    some = prints.join(kinds, ["form", "stored"], "left_semi").withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    one = some.select("form", F.col("stored").alias("s1"), F.col(key).alias("x"), "salt")
    two = some.select("form", F.col("stored").alias("s2"), F.col(key).alias("y"), "salt")
    left = pairs.withColumn("salt", every).join(one, ["form", "s1", "salt"]).drop("salt")
    both = left.withColumn("salt", every).join(two, ["form", "s2", "salt"])
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).filter("doc_a <> doc_b")
