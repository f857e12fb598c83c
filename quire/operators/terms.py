"""Term mining, containment, people by part of their name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HAN, all_caps, fold_text, title_case, words

#: Bytes of terms that one automaton holds; more terms take further passes over the texts.
TERM_BYTES = 16 << 20
CONTEXT_CHARS, CONTEXTS = 80, 2

# Closed-class words that are no term even where capitalised.
_CLOSED = """a an the this that these those i you he she it we they me him her us them my your his its our their
and but or nor for yet so because although though while if unless since until before after when whenever whereas wherever
what which who whom whose why how where in on at by with about against between into through during without above below
to from up down over under again further once of off out am is are was were be been being do does did have has had having
will would shall should may might must can could not no never none nothing nobody nowhere neither
there here now then just even also too very still only already soon always often sometimes usually perhaps maybe actually
really quite rather almost indeed oh ah well yes hey wow huh hmm um uh""".split()
_POSSESSIVE = [w + "s" for w in "your her our their".split()] + ["mine"]
_REFLEXIVE = [w + "self" for w in "my your him her it".split()] + [w + "selves" for w in "our your them".split()]
#: What an apostrophe that is no letter leaves of a contraction.
_CLIPPED = [w + "n" for w in "do did does is are was were wo would could should ai has have had must need".split()] + "ll ve re em".split()
STOP = tuple(dict.fromkeys([*_CLOSED, *_POSSESSIVE, *_REFLEXIVE, *_CLIPPED]))
# Small words that may stand inside a name.
CONNECTORS = "of the and de von van der du la le for in at".split()

# One token of a sentence whose tokens are joined by blanks. Java matches greedy groups by recursion, so that a long
# run would overflow the stack and end the executor; possessive ones are loops.
_TITLE = r"\p{Lu}(?=[^ ]*\p{Ll})[^\p{Lu}\p{Lt} ]+(?![^ ])"
_RUN = rf"(?<![^ ]){_TITLE}(?: (?:{_TITLE}|(?i:{'|'.join(CONNECTORS)})(?= {_TITLE})))*+"


def sentences(c: Column) -> Column:
    """Sentences of a text: after a terminator, any closing quotation marks and white space, or at line ends."""
    return F.split(c, r"(?<=[.!?…])[\"'”’]*(?U:\s+)|\n+")


def sentence_tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Word tokens of each sentence with their position in it."""
    s = df.select(key, F.posexplode(sentences(F.col(text))).alias("sent", "s"))
    return s.select(key, "sent", F.posexplode(words(F.col("s"))).alias("pos", "tok"))


def title_case_tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Of each title-case token: occurrences, documents, and whether it ever stands inside a sentence."""
    t = sentence_tokens(df, key, text).where(title_case(F.col("tok")))
    return t.groupBy("tok").agg(F.count("*").alias("token_total"), F.countDistinct(key).alias("n_docs"), F.bool_or(F.col("pos") != 0).alias("ever_inside"))


def _bare(run: Column) -> Column:
    """A run without the stop words at its ends; empty if there are no others. Linear in its words."""
    w = F.split(run, " ")
    counts = F.transform(w, lambda x: ~F.lower(x).isin(*STOP))
    first, after = F.array_position(counts, True), F.array_position(F.reverse(counts), True)
    return F.when(first > 0, F.array_join(F.slice(w, first.cast("int"), (F.size(w) - after - first + 2).cast("int")), " ")).otherwise("")


def sightings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every possible term where it stands: ``key``, sent, kind ('run', 'word', 'caps'), surface, context.

    A run is title-case words on end, with connectors between two of them; stop words at both ends go.
    What is left of one word is kind 'word', to be judged by the corpus. No text is shuffled.
    """
    s = df.select(key, F.posexplode(sentences(F.col(text))).alias("sent", "s")).withColumn("w", words(F.col("s")))
    runs = F.regexp_extract_all(F.array_join("w", " "), F.lit(_RUN), 0)
    found = F.transform(F.filter(F.transform(runs, _bare), lambda r: r != ""), lambda r: F.struct(F.when(F.contains(r, F.lit(" ")), "run").otherwise("word").alias("kind"), r.alias("surface")))
    caps = F.transform(F.filter("w", lambda x: all_caps(x) & ~F.lower(x).isin(*STOP)), lambda x: F.struct(F.lit("caps").alias("kind"), x.alias("surface")))
    context = F.substring(F.regexp_replace("s", r"(?U)^\s+", ""), 1, CONTEXT_CHARS).alias("context")
    return s.select(key, "sent", context, F.explode(F.concat(found, caps)).alias("f")).select(key, "sent", "f.kind", "f.surface", "context")


def candidates(df: DataFrame, key: str, text: str = "text", least: int = 2) -> DataFrame:
    """(surface, n, n_docs, first_doc): runs of several words, and words and capitals seen ``least`` times.

    A single word counts only if it stands title-case inside a sentence somewhere and ``least`` times in all.
    """
    seen = sightings(df, key, text).groupBy("kind", "surface").agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_docs"), F.min(key).alias("first_doc"))
    known = title_case_tokens(df, key, text).where(F.col("ever_inside") & (F.col("token_total") >= least)).select(F.col("tok").alias("surface"))
    word = seen.where("kind = 'word'").join(known, "surface", "left_semi")
    every = seen.where("kind <> 'word'").unionByName(word.select(*seen.columns))
    return every.where((F.col("kind") == "run") | (F.col("n") >= least)).select("surface", "n", "n_docs", "first_doc")


def contexts(df: DataFrame, key: str, text: str = "text", most: int = CONTEXTS) -> DataFrame:
    """(surface, nth, context): the first ``most`` different contexts of each surface, by key and sentence."""
    first = sightings(df, key, text).groupBy("surface", "context").agg(F.min(F.struct(key, "sent")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("surface").orderBy("at", "context"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select("surface", "nth", "context")


def merge_channels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates of two channels by lower-case surface: largest count, first channel's spelling."""
    both = a.select(F.lit(0).alias("ch"), "surface", "n").unionByName(b.select(F.lit(1).alias("ch"), "surface", "n"))
    return both.groupBy(F.lower("surface").alias("key")).agg(F.max("n").alias("n"), F.min(F.struct("ch", "surface")).alias("m")).select("key", "n", F.col("m.surface").alias("surface"))


def listed(rows: DataFrame, surface: str, chapter: str) -> DataFrame:
    """A listing channel: how often a surface is listed (repeats in a chapter count) and in how many chapters."""
    named = rows.select(F.trim(surface).alias("surface"), F.col(chapter).alias("chapter")).where("surface <> ''")
    return named.groupBy("surface").agg(F.count("*").alias("n"), F.countDistinct("chapter").alias("n_docs"), F.min("chapter").alias("first_doc"))


# Characters of Chinese and Japanese, whose terms have no word borders.
_UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))


def unspaced(text: str) -> bool:
    return any(a <= ord(c) <= b for c in text for a, b in _UNSPACED)


def _at_border(text: str, i: int) -> bool:
    """Whether exactly one of the characters around place ``i`` is a word character."""
    before, after = text[i - 1 : i] if i else "", text[i : i + 1]
    return (before.isalnum() or before == "_") != (after.isalnum() or after == "_")


def contained(docs: DataFrame, terms: DataFrame, doc_keys: list[str], text: str, term_keys: list[str], term: str, match: str = "lower") -> DataFrame:
    """Distinct (``doc_keys``, ``term_keys``) where the text contains the term.

    ``match``: 'exact'; 'lower' (lower case of both); 'fold' (compatibility forms and case folded); 'word'
    (exact, between word borders unless the term has a Chinese or Japanese character).

    Terms go to an Aho-Corasick automaton in every task, so a text is read once whatever the number of
    terms. An automaton holds ``TERM_BYTES`` of terms; larger term tables are dealt into as many parts by
    hash, each a pass of its own over the texts, with equal results. Null and empty terms and null texts
    match nothing; repeated rows of either side give one row.
    """
    plain: Callable[[str], str] = {"lower": str.lower, "fold": fold_text}.get(match, str)
    asked = terms.where(F.length(term) > 0).select(*term_keys, F.col(term).alias("t_"))
    weight = asked.agg(F.sum(F.octet_length("t_") + 32)).first()[0] or 0
    passes = max(1, -(-weight // TERM_BYTES))
    schema = docs.select(*doc_keys).schema
    for f in terms.select(*term_keys).schema.fields:
        schema = schema.add(f)
    found = None
    for part in range(passes):
        some = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("t_"), F.lit(passes)) == part)
        by: dict[str, list[tuple]] = {}
        for row in some.distinct().collect():
            by.setdefault(plain(row["t_"]), []).append(tuple(row)[:-1])
        held = docs.sparkSession.sparkContext.broadcast({t: ks for t, ks in by.items() if t})

        def run(batches: Iterator, held=held):
            import ahocorasick
            import pyarrow as pa

            auto = ahocorasick.Automaton()
            for t, ks in held.value.items():
                auto.add_word(t, (len(t), match == "word" and not unspaced(t), ks))
            auto.make_automaton()
            n = len(doc_keys)
            fields = None
            for b in batches:
                rows, hits = [], []
                for i, t in enumerate(b.column(n).to_pylist()):
                    if not t or not held.value:
                        continue
                    t, seen = plain(t), set()
                    for end, (size, bordered, ks) in auto.iter(t):
                        if id(ks) not in seen and not (bordered and not (_at_border(t, end + 1 - size) and _at_border(t, end + 1))):
                            seen.add(id(ks))
                            rows += [i] * len(ks)
                            hits += ks
                fields = fields or [pa.field(f.name, b.schema.field(k).type) for k, f in enumerate(schema.fields[:n])]
                left = b.select(list(range(n))).take(pa.array(rows, pa.int32()))
                right = [pa.array([h[k] for h in hits], _arrow(f.dataType)) for k, f in enumerate(schema.fields[n:])]
                yield pa.RecordBatch.from_arrays([*left.columns, *right], names=schema.names)

        got = docs.select(*doc_keys, text).mapInArrow(run, schema)
        found = got if found is None else found.unionByName(got)
    return found.distinct()


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# Kinds of terms that only their source stands for, aliases not.
SOURCE_ONLY = "称谓 敬称 口癖 固定表达".split()


def terms_in(docs: DataFrame, terms: DataFrame, doc_keys: list[str], text: str) -> DataFrame:
    """(``doc_keys``, source): terms (source, aliases, type) whose source, or alias, the text contains in any form or case."""
    names = F.when(F.col("type").isin(*SOURCE_ONLY), F.array("source")).otherwise(F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>"))))
    forms = terms.select("source", F.explode(names).alias("form"))
    return contained(docs, forms, doc_keys, text, ["source"], "form", match="fold")


def people_in(docs: DataFrame, people: DataFrame, doc_keys: list[str], text: str) -> DataFrame:
    """(``doc_keys``, source): people (source, aliases) that a part of their name may mean.

    Of names of several words any word of two characters or more: one with a Han character wherever it
    stands, another as a whole capitalised word. Of a Han name in one piece its first two or three characters.
    """
    names = people.select("source", F.explode(F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.withColumn("parts", F.filter(F.regexp_extract_all("name", F.lit(r"\p{L}+"), 0), lambda x: F.length(x) >= 2))
    several = names.where(F.size("parts") >= 2).select("source", F.explode("parts").alias("part"))
    starts = F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.when(F.length("name") > n, F.substring("name", F.lit(1), n)))
    whole = names.where((F.size("parts") < 2) & F.col("name").rlike(f"[{HAN}]")).select("source", F.explode(F.array_compact(starts)).alias("part"))
    anywhere = several.where(F.col("part").rlike(f"[{HAN}]")).unionByName(whole)
    capital = several.where(~F.col("part").rlike(f"[{HAN}]") & F.col("part").rlike(r"^\p{Lu}")).select("source", F.col("part").alias("word"))
    by_word = docs.select(*doc_keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}+"), 0))).alias("word")).join(capital, "word").select(*doc_keys, "source")
    return contained(docs, anywhere, doc_keys, text, ["source"], "part", match="exact").unionByName(by_word).distinct()


def chapter_terms(docs: DataFrame, terms: DataFrame, doc_keys: list[str], text: str) -> DataFrame:
    """(``doc_keys``, source): the terms of a text, and the locked people whom a part of their name may mean.

    ``terms``: (source, aliases, type, locked); people are of type 人物."""
    people = terms.where(F.col("locked") & (F.col("type") == "人物"))
    return terms_in(docs, terms, doc_keys, text).unionByName(people_in(docs, people, doc_keys, text)).distinct()
