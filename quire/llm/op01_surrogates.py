"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Entities: e-mail addresses, IPv4 addresses, card numbers, social-security and IBAN style numbers,
phone numbers, and names after a title (whose gender the title tells): all capitalised words that
follow, with particles and initials between (these stay), and the same words, so written or in
capitals, wherever else they stand in that text, each mention an entity found. Each is replaced by a value
of the same shape, drawn from a keyed hash of its canonical form (lower case; digits alone for
numbers), so all mentions of one entity, however written, receive the same surrogate:

* digits become digits, vowels vowels, consonants consonants, plain Latin, accented Latin, Cyrillic,
  Greek, Armenian and Georgian each among themselves, other letters a to z; punctuation, length and
  case stay; an address keeps its top-level domain, a card its first digit, a name its
  last letter (which marks gender in many languages) and its title;
* valid check digits of a card or account number become the valid ones of its surrogate;
* an IPv4 part becomes a number from 1 to 254.

Collision checks run over the whole corpus on the table of distinct entities: a surrogate that two
entities of a kind share, or that is itself an entity of the corpus, is drawn again with a higher
attempt number, until none is left. Where ``MAX_ROUNDS`` draws of one shape found none free, each
further one has two letters or a digit more, so shapes do not run out; only an IPv4 address has no
longer shape, and the query fails if ``IP_ROUNDS`` draws find none. The few entities with an attempt above 0 are looked up from
small broadcast maps (``MAP_ROWS`` rows each, as many maps as needed); all others follow from the
key alone, so texts are never shuffled and no mapping of the corpus is collected.

Null texts stay null with no entities. Repeated rows each get a row. Built-in functions only.
"""

from __future__ import annotations

import hashlib
import secrets
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, work_dir, written

#: Setting that holds the key; without it each run draws a key of its own.
KEY_SETTING = "spark.quire.surrogate.key"
#: Exceptions a broadcast map holds: about 60 bytes each.
MAP_ROWS = 50_000
#: Draws within the shape of the entity; the next ones have a longer shape.
MAX_ROUNDS = 12
#: Draws of an IPv4 address, whose shape is fixed: 254 ** 4 values.
IP_ROUNDS = 100

# Titles and the gender they tell.
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don Господин", "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Srta Doña Госпожа", "n": "Dr Prof"}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts.split())
_FIRST = "".join(sorted({t[0] for t in _TITLE.split("|")}))

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
CARD = r"(?<![\w+])\d{4}(?:[ -]?\d{4}){3}(?:\d{1,3})?(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+(])\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
# Words inside a name that stay, as do initials.
PARTICLES = "von van de der den della di da dos das du la le ten ter zu y bin ibn al"
_BETWEEN = rf"(?:\x20(?:(?:{'|'.join(PARTICLES.split())})(?=\x20)|\p{{Lu}}\.))*+"
NAME = r"\p{Lu}(?:\p{L}++|(?=(?!'s(?!\p{L}))['-]\p{L}))(?:(?!'s(?!\p{L}))['-]\p{L}++)*+"
PERSON = rf"(?=[{_FIRST}])(?<!\w)(?:{_TITLE})\.?(?:\x20(?:{_TITLE})\.?(?=\x20))*+(?:{_BETWEEN}\x20{NAME})(?:{_BETWEEN}\x20{NAME})*+"
ANY = rf"(?=[A-Za-z\d+({_FIRST}])(?:" + "|".join((EMAIL, IP, CARD, SSN, PHONE, IBAN, PERSON)) + ")"
#: Cheap test that a text may hold an entity.
MAYBE = rf"@|\d[\d .()-]{{4,}}\d|(?=[{_FIRST}])(?<!\w)(?:{_TITLE})\.?\x20(?:\p{{Lu}}|(?:{'|'.join(PARTICLES.split())})\x20)"


def _kind(e: str) -> str:
    tests = [("email", "^.*@.*$"), ("ip", r"^\d{1,3}(?:\.\d{1,3}){3}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("card", r"^\d{4}(?:[ -]?\d{4}){3}\d{0,3}$"), ("phone", r"^[+(\d][\d .()-]+$"), ("iban", r"^[A-Z]{2}\d{2}.*\d.*$")]
    out = "'person'"
    for kind, test in reversed(tests):
        out = f"IF({e} rlike r'{test}', '{kind}', {out})"
    return out


def _canon(kind: str, e: str) -> str:
    return f"CASE WHEN {kind} IN ('card', 'phone', 'ssn') THEN regexp_replace({e}, '[^0-9]', '') WHEN {kind} = 'iban' THEN lower(replace({e}, ' ', '')) WHEN {kind} IN ('email', 'name') THEN lower({e}) ELSE {e} END"


# Letters that replace each other.
_SAME = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ")
#: (letters, what they become); letters whose case or end form is irregular are never drawn.
_CLASSES = (
    *zip(_SAME, _SAME),
    ("àáâãäåāăąæèéêëēĕėęěìíîïĩīĭįıòóôõöøōŏőœùúûüũūŭůűųýÿ", "àáâãäåèéêëìíîïòóôõöøùúûü"),
    ("çćĉċčďđðĝğġģĥħĵķĺļľłñńņňŕŗřśŝşšșßťţțþŵźżž", "çćčďłñńňřśšťźž"),
    ("ёіїєўѐѝ", "ёіїє"),
    ("йґђѓѕјљњћќџъь", "йґђјљњћџ"),
    ("αάεέηήιίϊΐοόυύϋΰωώ", "αάεέηήιίοόυύωώ"),
    ("βγδζθκλμνξπρσςτφχψ", "βγδζθκλμνξπρτφχψ"),
    ("աեէըիոօ", "աեէըիոօ"),
    ("բգդզթժլխծկհձղճմյնշչպջռսվտրցւփքֆև", "բգդզթժլխծկհձղճմյնշչպջռսվտրցփքֆ"),
    ("აეიოუ", "აეიოუ"),
    ("ბგდვზთკლმნპჟრსტფქღყშჩცძწჭხჯჰ", "ბგდვზთკლმნპჟრსტფქღყშჩცძწჭხჯჰ"),
)
#: What letters of any other script become.
_OTHER = "abcdefghijklmnopqrstuvwxyz"


def _longer(kind: str, e: str, attempt: str) -> str:
    """SQL of ``e``, from attempt MAX_ROUNDS on with more places to draw, so that no shape runs out."""
    more = f"cast({attempt} AS int) - {MAX_ROUNDS - 1}"
    name = f"concat(substring({e}, 1, length({e}) - 1), repeat(IF({e} = upper({e}), 'AN', 'an'), {more}), substring({e}, length({e}), 1))"
    return f"CASE WHEN {kind} = 'ip' OR {more} < 1 THEN {e} WHEN {kind} = 'name' THEN {name} WHEN {kind} = 'email' THEN concat(repeat('an', {more}), {e}) ELSE concat({e}, repeat('0', {more})) END"


def _luhn(digits: str) -> str:
    """SQL of the check digit that makes ``digits``, whose last one is not looked at, a card number."""
    x = f"int(substring({digits}, length({digits}) - i, 1))"
    total = f"aggregate(sequence(1, length({digits}) - 1), 0, (a, i) -> a + IF(i % 2 = 1, 2 * {x} - IF({x} > 4, 9, 0), {x}))"
    return f"string((10 - {total} % 10) % 10)"


def _iban(s: str) -> str:
    """SQL of the two check digits of an account number in capitals without blanks."""
    turned = f"concat(substring({s}, 5), substring({s}, 1, 2), '00')"
    step = "IF(c rlike '[0-9]', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"lpad(string(98 - aggregate(split({turned}, ''), 0, (a, c) -> {step})), 2, '0')"


def _checked(kind: str, e: str, s: str) -> str:
    """SQL of ``s`` with the check digits of a card or account number, where ``e`` has valid ones."""
    digits, plain = (lambda x: f"regexp_replace({x}, '[^0-9]', '')"), (lambda x: f"replace({x}, ' ', '')")
    card = f"IF(substring({e}, length({e}), 1) = {_luhn('d')}, concat(substring({s}, 1, length({s}) - 1), transform(array({digits(s)}), d -> {_luhn('d')})[0]), {s})"
    iban = f"IF(substring({e}, 3, 2) = {_iban(plain(e))}, concat(substring({s}, 1, 2), {_iban(plain(s))}, substring({s}, 5)), {s})"
    return f"CASE {kind} WHEN 'card' THEN transform(array({digits(e)}), d -> {card})[0] WHEN 'iban' THEN {iban} ELSE {s} END"


def _draw(key: str, kind: str, canon: str, e: str, attempt: str) -> str:
    """SQL of the surrogate of ``e`` whose canonical form is ``canon``."""
    seed = f"concat('{hashlib.sha256(key.encode()).hexdigest()}|', {kind}, '|', {canon}, '|', {attempt}, '|')"
    bytes_ = "concat(" + ", ".join(f"sha2(concat({{seed}}, '{i}'), 256)" for i in range(6)) + ")"
    bytes_ = bytes_.format(seed=seed)
    at = "int(conv(substring(h, pmod(acc.k, 96) * 4 + 1, 4), 16, 10))"
    pick = "CASE " + " ".join(f"WHEN locate(lower(c), '{cl}') > 0 THEN substring('{to}', pmod({at}, {len(to)}) + 1, 1)" for cl, to in _CLASSES)
    pick += rf" WHEN ascii(c) > 127 AND c rlike r'^\pL$' THEN substring('{_OTHER}', pmod({at}, {len(_OTHER)}) + 1, 1) END"
    step = f"transform(array({pick}), r -> IF(r IS NULL, struct(concat(acc.s, c) AS s, acc.k AS k), struct(concat(acc.s, IF(c = lower(c), r, upper(r))) AS s, acc.k + 1 AS k)))[0]"
    walk = f"aggregate(split({{body}}, ''), struct('' AS s, {{k}} AS k), (acc, c) -> {step}, acc -> acc.s)"
    plain = walk.format(body="e", k="0")
    tail = lambda cut: f"concat({walk.format(body=f'substring(e, 1, length(e) - {cut})', k='0')}, substring(e, length(e) - {cut} + 1, {cut}))"
    email = tail("length(substring_index(e, '.', -1))")
    card = f"concat(substring(e, 1, 1), {walk.format(body='substring(e, 2)', k='0')})"
    iban = f"concat(substring(e, 1, 2), {walk.format(body='substring(e, 3)', k='0')})"
    ip = "concat_ws('.', transform(sequence(0, 3), i -> string(pmod(int(conv(substring(h, i * 4 + 1, 4), 16, 10)), 254) + 1)))"
    body = f"CASE {kind} WHEN 'email' THEN {email} WHEN 'card' THEN {card} WHEN 'iban' THEN {iban} WHEN 'ip' THEN {ip} WHEN 'name' THEN {tail('1')} ELSE {plain} END"
    drawn = f"transform(array({bytes_}), h -> {body})[0]"
    return f"transform(array({_longer(kind, e, attempt)}), e -> transform(array({drawn}), s -> {_checked(kind, 'e', 's')})[0])[0]"


def _named(w: str) -> str:
    """SQL: whether a word of a person is a name, neither title, initial nor particle."""
    return rf"""({w} rlike r"^\p{{Lu}}[\p{{L}}'-]+$" AND NOT {w} rlike r"^(?:{_TITLE})$")"""


def _entities(found: str) -> str:
    """SQL: array of (kind, e) of the found strings; a name's words are entities of their own."""
    words = f"transform(filter(split(e, ' '), w -> {_named('w')}), w -> struct('name' AS kind, w AS e))"
    return f"flatten(transform({found}, e -> IF({_kind('e')} = 'person', {words}, array(struct({_kind('e')} AS kind, e AS e)))))"


def entity_table(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canon, form) of the corpus; form is one way the entity is written."""
    found = docs.where(F.col("text").rlike(MAYBE)).select(F.regexp_extract_all("text", F.lit(ANY), 0).alias("f")).where("size(f) > 0")
    one = found.select(F.explode(F.expr(_entities("f"))).alias("x")).select("x.kind", "x.e")
    one = one.select("kind", F.expr(_canon("kind", "e")).alias("canon"), "e")
    return one.groupBy("kind", "canon").agg(F.min("e").alias("form"))


def exceptions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first draw is not theirs alone; usually few."""
    here = work_dir(entities.sparkSession)
    entities = written(entities, f"{here}/entities")
    own = entities.select(F.col("kind").alias("k2"), F.col("canon").alias("c2"))
    draw = lambda df: df.withColumn("s", F.expr(_canon("kind", f"({_draw(key, 'kind', 'canon', 'form', 'attempt')})")))
    state = draw(entities.withColumn("attempt", F.lit(0)))
    settled = None
    for n in count():
        taken = state if settled is None else settled.unionByName(state)
        rank = F.row_number().over(Window.partitionBy("kind", "s").orderBy("attempt", "canon"))
        seen = taken.withColumn("rank", rank).join(own, (F.col("kind") == F.col("k2")) & (F.col("s") == F.col("c2")), "left")
        seen = written(seen.select("kind", "canon", "form", "attempt", "s", (F.col("c2").isNotNull() | (F.col("rank") > 1)).alias("bad")), f"{here}/round{n}")
        again = seen.where("bad")
        if again.isEmpty():
            return seen.where("attempt > 0").select("kind", "canon", "attempt")
        if n >= IP_ROUNDS and not again.where("kind = 'ip'").isEmpty():
            raise ValueError(f"no free IPv4 address found for {again.count()} entities in {n + 1} draws")
        settled = seen.where("NOT bad").drop("bad")
        state = draw(again.select("kind", "canon", "form", (F.col("attempt") + 1).alias("attempt")))


def _attempts(maps: int) -> str:
    hits = [f"try_element_at(m{i}, concat(kind, '|', canon))" for i in range(maps)]
    return f"string(coalesce({', '.join([*hits, '0'])}))"


def replace_entities(docs: DataFrame, odd: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` replaced and n_entities and kinds (array) added; other columns of any name stay."""
    keep = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_"), "text")
    maps = -(-odd.count() // MAP_ROWS)
    t = docs
    for i in range(maps):
        part = odd.where(F.pmod(F.xxhash64("kind", "canon"), F.lit(maps)) == i)
        one = part.agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "canon"), "attempt"))).alias(f"m{i}"))
        t = t.crossJoin(F.broadcast(one))  # one row
    has = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    t = t.withColumn("f_", F.when(has, F.regexp_extract_all("text", F.lit(ANY), 0)))
    # Names of the text's persons, whole words, wherever else they stand in it.
    names = f"flatten(transform(filter(f_, e -> {_kind('e')} = 'person'), e -> filter(split(e, ' '), w -> {_named('w')})))"
    names = f"transform(array({names}), n -> array_sort(array_distinct(concat(n, transform(n, w -> upper(w)))), (a, b) -> length(b) - length(a)))[0]"
    t = t.withColumn("names_", F.expr(f"IF(size(f_) > 0, {names}, NULL)"))
    bare = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}_])(?:"), F.array_join("names_", "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    t = t.withColumn("any_", F.when(F.size("names_") > 0, bare))
    t = t.withColumn("f_", F.when(F.col("any_").isNotNull(), F.regexp_extract_all("text", F.col("any_"), 0)).otherwise(F.col("f_")))
    attempts = _attempts(maps)

    def one_of(kind: str, e: str) -> str:
        canon = _canon("kind", "w")
        return f"transform(array(named_struct('kind', {kind}, 'w', {e})), z -> transform(array(z.kind), kind -> transform(array(z.w), w -> transform(array({canon}), canon -> {_draw(key, 'kind', 'canon', 'w', attempts)})[0])[0])[0])[0]"

    name = f"concat_ws(' ', transform(split(e, ' '), p -> IF({_named('p')}, {one_of(repr('name'), 'p')}, p)))"
    new = f"transform(f_, e -> transform(array({_kind('e')}), q -> IF(q = 'person', {name}, {one_of('q', 'e')}))[0])"
    t = t.withColumn("kinds", F.expr(f"coalesce(transform(f_, e -> {_kind('e')}), cast(array() AS array<string>))"))
    t = t.withColumn("new_", F.expr(f"IF(size(f_) > 0, {new}, NULL)"))
    t = t.withColumn("gaps_", F.when(F.col("any_").isNotNull(), F.split("text", F.col("any_"), -1)).when(F.size("f_") > 0, F.split("text", ANY, -1)))
    t = t.withColumn("text", F.when(F.size("f_") > 0, F.expr("array_join(flatten(zip_with(gaps_, new_, (g, n) -> array(g, coalesce(n, '')))), '')")).otherwise(F.col("text")))
    return t.withColumn("n_entities", F.size("kinds").cast("bigint")).select(*[F.col("text") if c == "text" else F.col(f"row_.`{c}`").alias(c) for c in keep], "n_entities", "kinds")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` under a secret ``key``: the same key gives the same surrogates for the same corpus."""
    return replace_entities(docs, exceptions(entity_table(docs), key), key)


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    return with_surrogates(docs, key).select("doc_id", "n_entities", F.array_join("kinds", ",").alias("kinds"), "text")
