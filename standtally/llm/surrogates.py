"""PII surrogates: detected entities get keyed, type-consistent replacements.

Found are mail addresses, telephone and card numbers, IPv4 addresses, social security and
bank account numbers, access tokens, and personal names after a form of address. A surrogate
has the length, punctuation, letter case and script of what it replaces; digits stand for
digits, a card number that passes its check digit still does, an address stays in a range
that is never routed, a name after a male or female form of address is male or female.

An entity's surrogate depends on the key, its type and its normal form (a telephone number's
digits, a mail address in lower case), so all mentions in the corpus change alike. Surrogates
of different entities are checked against each other and against all entities found; those
that collide are drawn anew. Where a form of entity is so crowded that some still collide after
``ROUNDS`` draws, as when a corpus holds all numbers of a length, these exchange their texts
among themselves in a keyed order: each gets another's, so all stay distinct.

A name found after a form of address is replaced wherever it stands as a word in that text,
written alike. Where two mentions share a word as given name and surname, bare words follow the
first of them.

Everything is built-in expressions: no Python runs on the executors. Missing texts stay
missing, texts without entities stay as they are, byte for byte. Repeated rows change alike.
An empty table gives an empty result. Columns other than ``text`` pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standtally.llm.common import join_many_to_one, let
from standtally.operators.ranking import dense_rank_keys
from standtally.sources.staging import broadcast_if_small, fits_broadcast, stage

KEY_SETTING = "spark.standtally.surrogateKey"
ROUNDS = 12
TASK_ROWS = 5000

MALE = r"Mr|Herrn?|Señor|Monsieur|г-н"
FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Madame|Mme|г-жа"
TITLE = rf"(?:{MALE}|{FEMALE})\.?"
NAME = r"\p{Lu}\p{L}{1,30}"

# Every form starts where no letter or digit stands before it.
START = r"(?<![\p{L}\p{N}])"
MAIL = r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}+\p{L}{2,24}"
PHONE = (
    r"\+?\d{1,3}[ .-]?\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\p{N})"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\p{N})"
    r"|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\p{N})"
)
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{N}-])"
IBAN = r"[A-Z]{2}\d{2}(?: ?\d{4}){3,6}(?: ?\d{1,3})?(?!\p{N})"
CARD = r"(?:(?:\d{4}[ -]){3}\d{4}|\d{13,19})(?![\p{L}\p{N}])"
IPV4 = r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\p{N}|\.\d)"
TOKEN = (
    r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}"
    r"|sk-[0-9A-Za-z_-]{20,64})(?![\p{L}\p{N}])"
)
PERSON = rf"{TITLE} {NAME}(?: (?={NAME}))?"
# The second of two names looks back at the form of address, after a cheap look at a blank.
SECOND = rf"(?<=\p{{L}} ){NAME}(?<=(?:{TITLE}) {NAME} {NAME})"
# Longer forms go first where two could start at one place.
ENTITY = rf"{START}(?:{'|'.join([MAIL, IBAN, TOKEN, CARD, PHONE, SSN, IPV4, PERSON])})|{SECOND}"
# No entity lacks all of these; most texts are passed by on them.
TITLE_HINTS = ("Mr", "Ms", "Miss", "Mme", "Herr", "Frau", "Señor", "Monsieur", "Madame", "г-")


def may_hold_entities(text: Column) -> Column:
    hint = text.rlike("[0-9@]")
    for title in TITLE_HINTS:
        hint = hint | text.contains(title)
    return hint


# Sixteen letters of each script that surrogates are spelt with.
LATIN = "aeioulnrstmdkbpv"
GREEK = "αεηιολνρστμδκβπγ"
CYRILLIC = "аеиоулнрстмдкбпв"
HAN = "王李张刘陈杨赵黄周吴徐孙马朱胡林"
KANA = "アイウエオカキクケコサシスセソタ"
HANGUL = "가나다라마바사아자차카타파하고노"
# Given names and the syllables of surnames.
MALE_NAMES = ("Adrian", "Bruno", "Carl", "Dario", "Emil", "Felix", "Georg", "Hugo", "Ivo", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oskar", "Paul")
FEMALE_NAMES = ("Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula")
SYLLABLES = ("ba", "den", "fo", "gar", "hal", "ki", "lor", "men", "ni", "pol", "ra", "sel", "ta", "ver", "wim", "zu")

HEX = "0123456789abcdef"


def kind_of(raw: Column) -> Column:
    """The type of a mention, from its text alone."""
    digits = F.length(F.regexp_replace(raw, r"\P{Nd}", ""))
    return (
        F.when(raw.contains("@"), "mail")
        .when(raw.rlike(rf"^{TITLE} .* $"), F.when(raw.rlike(rf"^(?:{FEMALE})\.? "), "given_f").otherwise("given_m"))
        .when(raw.rlike(rf"^(?:{TITLE} )?{NAME}$"), "surname")
        .when(raw.rlike(rf"^(?:{IBAN})$"), "iban")
        .when(raw.rlike(rf"^(?:{TOKEN})$") & (raw.rlike("[A-Za-z]") | (digits > 19)), "token")
        .when(raw.rlike(rf"^(?:{CARD})$"), "card")
        .when(raw.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(raw.rlike(rf"^(?:{IPV4})$"), "ipv4")
        .otherwise("phone")
    )


def normal_form(kind: Column, raw: Column) -> Column:
    """What all mentions of one entity have in common."""
    numbers = kind.isin("phone", "card", "ssn", "iban")
    name = F.trim(F.regexp_replace(raw, rf"^{TITLE} ", ""))
    return (
        F.when(numbers, F.upper(F.regexp_replace(raw, r"[^\p{L}\p{Nd}]", "")))
        .when(kind.isin("given_f", "given_m", "surname"), F.lower(name))
        .otherwise(F.lower(raw))
    )


def _stream(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """256 keyed hexadecimal digits of an entity."""
    parts = [
        F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(n)), kind, form, attempt.cast("string")), 256)
        for n in range(4)
    ]
    return F.concat(*parts)


def _at(stream: Column, place: Column) -> Column:
    return F.substr(stream, (place % 256 + 1).cast("int"), F.lit(1))


def _byte(stream: Column, n: int) -> Column:
    return F.conv(F.substring(stream, n + 1, 4), 16, 10).cast("int")


# What the 16 hexadecimal digits become for a character, by the first form that it has. Only
# letters of tokens stay hexadecimal.
DIGITS = "0123456789012345"
HEX_LETTERS = "abcdefabcdabcdef"
ALPHABETS = {
    r"\p{IsGreek}": GREEK, r"\p{IsCyrillic}": CYRILLIC, r"\p{IsHan}": HAN,
    r"[\p{IsHiragana}\p{IsKatakana}]": KANA, r"\p{IsHangul}": HANGUL, r"\p{L}": LATIN,
}


def _spelt(raw: Column, stream: Column, kind: Column) -> Column:
    """Digit for digit and letter for letter, in the script and case of the mention.

    Digits are counted apart from other characters, so that a number spelt with other
    separators gets the same digits.
    """

    def one(c: Column, i: Column, kept: Column) -> Column:
        digit = c.rlike(r"^\p{Nd}$")
        alphabet = F.when(digit, DIGITS).when((kind == "token") & c.rlike("^[A-Fa-f]$"), HEX_LETTERS)
        for form, letters in ALPHABETS.items():
            alphabet = alphabet.when(c.rlike(f"^{form}$"), letters)
        nth = F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), r"\P{Nd}", ""))
        # Where a character takes its digit of the stream; missing where it stays as it is.
        place = F.when(~digit, i + 64).when(nth >= kept, nth)

        def written(letters: Column) -> Column:
            sign = F.substr(letters, F.instr(F.lit(HEX), _at(stream, place)), F.lit(1))
            return F.coalesce(F.when(c == F.lower(c), sign).otherwise(F.upper(sign)), c)

        return let(alphabet, written)

    def whole(kept: Column) -> Column:
        return F.array_join(F.transform(F.split(raw, ""), lambda c, i: one(c, i, kept)), "")

    return let(kept_prefix(raw, kind), whole)


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string, modulo 10; 0 for a valid card number."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        def part(d: Column) -> Column:
            return F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

        return total + let(F.substr(digits, i, F.lit(1)).cast("int"), part)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _card(raw: Column, stream: Column, spelt: Column) -> Column:
    """A number that passes the check sum exactly if the mention does."""
    off = F.when(_luhn(F.regexp_replace(raw, r"\D", "")) == 0, 0).otherwise(1 + _byte(stream, 200) % 9)

    def checked(body: Column) -> Column:
        rest = _luhn(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0")))
        return F.concat(body, ((20 - rest + off) % 10).cast("string"))

    return let(F.substr(spelt, F.lit(1), F.length(spelt) - 1), checked)


def _mail(local: Column, stream: Column, spelt: Column) -> Column:
    """The local part letter for letter, the domain under a name reserved for examples."""
    domain = F.concat(F.translate(F.substring(stream, 129, 10), HEX, LATIN), F.lit(".example.org"))
    shouted = (local == F.upper(local)) & (local != F.lower(local))
    return F.concat(spelt, F.lit("@"), F.when(shouted, F.upper(domain)).otherwise(domain))


def _name(raw: Column, name: Column, stream: Column, kind: Column, attempt: Column, spelt: Column) -> Column:
    """A given name of the same gender or a surname, after the form of address as it was."""
    title = F.regexp_extract(raw, rf"^({TITLE} )", 1)
    latin = name.rlike(r"^[\p{IsLatin}]+$")
    female = kind == "given_f"
    names = F.when(female, F.array(*map(F.lit, FEMALE_NAMES))).otherwise(F.array(*map(F.lit, MALE_NAMES)))
    given = F.element_at(names, _byte(stream, 0) % 16 + 1)
    syllables = F.array(*map(F.lit, SYLLABLES))
    is_given = kind.isin("given_f", "given_m")

    # A short list can't tell many given names apart: later draws lengthen the name.
    def written(drawn: Column) -> Column:
        longer = F.when(attempt == 0, given).otherwise(F.concat(given, drawn, F.when(female, "a").otherwise("o")))
        return F.when(is_given, longer).otherwise(F.initcap(drawn))

    drawn = F.array_join(
        F.transform(
            F.sequence(F.lit(0), attempt + F.when(is_given, 0).otherwise(3)),
            lambda i: F.get(syllables, F.instr(F.lit(HEX), _at(stream, i + 8)) - 1),
        ),
        "",
    )
    return F.concat(
        title, F.when(latin, let(drawn, written)).otherwise(spelt), F.when(raw.endswith(" "), " ").otherwise("")
    )


def surrogate(raw: Column, kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The replacement of a mention of the entity (kind, form) at its so-many-th draw.

    What several branches use is computed once and stands once in the expression, which the
    driver plans anew for each draw.
    """
    is_name = kind.isin("given_f", "given_m", "surname")
    body = (
        F.when(kind == "mail", F.substring_index(raw, "@", 1))
        .when(is_name, F.trim(F.regexp_replace(raw, rf"^{TITLE} ", "")))
        .when(kind == "ipv4", "")
        .otherwise(raw)
    )

    def written(stream: Column, body: Column, spelt: Column) -> Column:
        address = F.concat_ws(
            ".",
            (F.lit(240) + _byte(stream, 0) % 15).cast("string"),
            *[(_byte(stream, 4 * n) % 256).cast("string") for n in (1, 2, 3)],
        )
        return (
            F.when(kind == "mail", _mail(body, stream, spelt))
            .when(kind == "ipv4", address)
            .when(kind == "card", _card(raw, stream, spelt))
            .when(is_name, _name(raw, body, stream, kind, attempt, spelt))
            .otherwise(spelt)
        )

    def spelt_and_written(stream: Column, body: Column) -> Column:
        return let(_spelt(body, stream, kind), lambda spelt: written(stream, body, spelt))

    return let(_stream(key, kind, form, attempt), lambda stream: let(body, lambda b: spelt_and_written(stream, b)))


def kept_prefix(raw: Column, kind: Column) -> Column:
    """How many leading digits of a mention stay: the country code of a telephone number."""
    prefix = F.length(F.regexp_extract(raw, r"^\+?(\d{0,3})(?=[ .-]?\(|[ .-])", 1))
    return F.when((kind == "phone") & raw.startswith("+"), prefix).otherwise(0)


SCRIPTS = {"IsGreek": "α", "IsCyrillic": "а", "IsHan": "王", "IsHiragana": "ア", "IsKatakana": "ア", "IsHangul": "가"}


def shape_of(kind: Column, form: Column, sample: Column) -> Column:
    """What entities that may exchange their texts have in common: all but digits and letters
    other than country codes, and whether a card number is valid."""
    kept = kept_prefix(sample, kind)
    digits = F.concat(
        F.substr(form, F.lit(1), kept), F.regexp_replace(F.substr(form, kept + 1, F.length(form)), r"\p{Nd}", "0")
    )
    valid = F.when(kind == "card", (_luhn(F.regexp_replace(form, r"\D", "")) == 0).cast("string")).otherwise("")
    spelt = form
    for script, letter in SCRIPTS.items():
        spelt = F.regexp_replace(spelt, rf"\p{{{script}}}", letter)
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), F.concat_ws(" ", digits, valid))
        .when(kind == "ipv4", "")
        .otherwise(F.regexp_replace(F.regexp_replace(spelt, r"\p{IsLatin}", "a"), r"\p{Nd}", "0"))
    )


def written_over(raw: Column, kind: Column, other: Column) -> Column:
    """A mention with the letters and digits of another entity's normal form."""
    title = F.regexp_extract(raw, rf"^({TITLE} )", 1)
    body = F.substr(raw, F.length(title) + 1, F.length(raw))
    signs = F.split(F.regexp_replace(other, r"[^\p{L}\p{Nd}]", ""), "")

    def one(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substr(body, F.lit(1), i + 1), r"[^\p{L}\p{Nd}]", ""))
        sign = F.get(signs, nth - 1)
        cased = F.when(c == F.lower(c), sign).otherwise(F.upper(sign))
        return F.when(c.rlike(r"^[\p{L}\p{Nd}]$"), cased).otherwise(c)

    return F.when(kind == "ipv4", other).otherwise(
        F.concat(title, F.array_join(F.transform(F.split(body, ""), one), ""))
    )


def exchanged(judged: DataFrame, key: str) -> DataFrame:
    """(kind, form, other): the entities that clash to the last, each with the next one's form
    in a keyed order of its kind and shape. One that is alone there meets one that has a
    surrogate already, which then gives it up."""
    order = F.concat(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "form"), 256), F.lit(":"), F.col("form"))
    shaped = stage(
        judged.select(
            "kind", "form", "clash", shape_of(F.col("kind"), F.col("form"), F.col("sample")).alias("shape"),
            order.alias("order"),
        ),
        "shapes",
    )
    groups = shaped.groupBy("kind", "shape").agg(
        F.count_if("clash").alias("clashes"), F.min(F.when(~F.col("clash"), F.col("order"))).alias("partner")
    )
    groups = stage(groups.filter("clashes > 0"), "shapes")
    lost = groups.filter("clashes = 1 and partner is null").count()
    if lost:
        raise RuntimeError(f"{lost} entities are the only ones of their form and found no surrogate")
    taking = stage(
        shaped.join(broadcast_if_small(groups), ["kind", "shape"])
        .filter("clash or (clashes = 1 and order = partner)")
        .select("kind", "shape", "order", "form"),
        "exchanging",
    )
    ranked = dense_rank_keys(taking, ["kind", "shape"], "order", "n")
    numbered = stage(taking.join(ranked, ["kind", "shape", "order"]), "exchanging")
    last = numbered.groupBy("kind", "shape").agg(F.max("n").alias("last"))
    after = numbered.select("kind", "shape", F.col("n").alias("next"), F.col("form").alias("other"))
    turned = numbered.join(broadcast_if_small(last), ["kind", "shape"]).withColumn(
        "next", F.when(F.col("n") == F.col("last"), 1).otherwise(F.col("n") + 1)
    )
    return turned.join(after, ["kind", "shape", "next"]).select("kind", "form", "other")


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Rows that cost milliseconds each, over tasks of at most ``TASK_ROWS``, two a core at least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, rows // TASK_ROWS + 1))


def draw(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, form, sample, attempt, other): each entity's first draw that meets no other.

    Surrogates are compared in their normal form. Of several entities with one surrogate the
    first in order keeps it; the others draw anew, and so does one whose surrogate is itself
    an entity of the corpus. ``other`` is the entity whose text those take over that still
    clash in the end, else missing. Only numbers of rows are known to the driver.
    """
    entities = stage(entities, "entities")
    n = entities.count()
    current = entities.withColumns(
        {"attempt": F.lit(0), "clash": F.lit(True), "result": F.lit(None).cast("string")}
    )
    for turn in range(rounds):
        again = let(
            surrogate(F.col("sample"), F.col("kind"), F.col("form"), F.col("attempt"), key),
            lambda drawn: normal_form(F.col("kind"), drawn),
        )
        drawn = stage(
            spread(current, n).withColumn("result", F.when(F.col("clash"), again).otherwise(F.col("result"))).drop("clash"),
            "surrogates",
        )
        held = drawn.groupBy("kind", "result").agg(F.min("form").alias("holder"))
        real = drawn.select("kind", F.col("form").alias("result"), F.lit(True).alias("real"))
        clash = (F.col("holder") != F.col("form")) | F.coalesce("real", F.lit(False))
        judged = drawn.join(held, ["kind", "result"]).join(real, ["kind", "result"], "left").withColumn("clash", clash)
        more = F.col("clash").cast("int") if turn + 1 < rounds else F.lit(0)
        current = stage(
            judged.select("kind", "form", "sample", (F.col("attempt") + more).alias("attempt"), "clash", "result"),
            "surrogates",
        )
        if not current.filter("clash").count():
            return current.select("kind", "form", "sample", "attempt", F.lit(None).cast("string").alias("other"))
    took = exchanged(current, key)
    return stage(
        current.join(took, ["kind", "form"], "left").select("kind", "form", "sample", "attempt", "other"), "surrogates"
    )


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with surrogates in ``text``, and a struct ``pii``.

    ``pii`` counts the mentions and names their kinds. Only texts with entities are moved:
    distinct texts give their mentions, the mentions meet their entities' draws, and the
    finished list of a text comes back to the rows that hold it. Without ``key`` the session's
    setting ``KEY_SETTING`` is the key. Runs jobs.
    """
    key = docs.sparkSession.conf.get(KEY_SETTING, "standtally") if key is None else key
    given = [c for c in docs.columns if c != "pii"]
    dirty_text = may_hold_entities(F.col("text")) & F.col("text").rlike(ENTITY)
    none = F.struct(F.lit(0).cast("bigint").alias("n_entities"), F.lit("").alias("kinds"))
    clean = docs.filter(~F.coalesce(dirty_text, F.lit(False))).select(
        *[f"`{c}`" for c in given], none.alias("pii")
    )
    tag = F.concat(F.xxhash64("text"), F.lit(":"), F.xxhash64(F.lit(1), F.col("text")))
    dirty = docs.filter(dirty_text).select(F.struct(*[f"`{c}`" for c in given]).alias("_doc"), tag.alias("_tag"))
    mentions = stage(
        docs.filter(dirty_text)
        .select(tag.alias("tag"), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("found"))
        .groupBy("tag")
        .agg(F.first("found").alias("found"))
        .select("tag", F.posexplode("found").alias("place", "raw"))
        .withColumn("kind", kind_of(F.col("raw")))
        .withColumn("form", normal_form(F.col("kind"), F.col("raw"))),
        "mentions",
    )
    entities = mentions.groupBy("kind", "form").agg(F.min("raw").alias("sample"))
    drawn = draw(entities, key).drop("sample")
    spellings = stage(mentions.select("kind", "form", "raw").distinct(), "spellings")
    own = surrogate(F.col("raw"), F.col("kind"), F.col("form"), F.col("attempt"), key)
    taken = written_over(F.col("raw"), F.col("kind"), F.col("other"))
    changes = stage(
        spread(spellings.join(broadcast_if_small(drawn), ["kind", "form"]), spellings.count()).select(
            "raw", "kind", F.when(F.col("other").isNull(), own).otherwise(taken).alias("new")
        ),
        "changes",
    )
    if fits_broadcast(changes):
        met = mentions.join(F.broadcast(changes), ["kind", "raw"])
    else:
        met = join_many_to_one(mentions, changes, ["kind", "raw"])
    met = stage(met.select("tag", "place", "raw", "kind", "new"), "changed")
    lists = met.groupBy("tag").agg(
        F.array_sort(F.collect_list(F.struct("place", "new"))).alias("_new"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("_kinds"),
    )
    bare = lambda c: F.trim(F.regexp_replace(c, rf"^{TITLE} ", ""))
    words = (
        met.filter(F.col("kind").isin("given_f", "given_m", "surname"))
        .select("tag", "place", bare("raw").alias("word"), bare("new").alias("named"))
        .groupBy("tag", "word")
        .agg(F.min_by("named", "place").alias("named"))
        .groupBy("tag")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "named"))).alias("_words"))
    )
    text = F.col("_doc.text")

    def renamed(part: Column) -> Column:
        """The text between two mentions, with the names of the text replaced in it."""
        pieces = F.regexp_extract_all(part, F.lit(r"(?s)[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
        written = F.array_join(F.transform(pieces, lambda w: F.coalesce(F.element_at("_words", w), w)), "")
        named = F.exists(F.map_keys("_words"), lambda w: F.contains(part, w))
        return F.when(named, written).otherwise(part)

    between = F.transform(F.split(text, ENTITY, -1), renamed)
    rebuilt = F.array_join(
        F.flatten(
            F.zip_with(between, F.col("_new.new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))
        ),
        "",
    )
    changed = dirty.join(lists.join(words, "tag", "left"), F.col("_tag") == F.col("tag")).select(
        *[rebuilt.alias("text") if c == "text" else F.col("_doc")[c].alias(c) for c in given],
        F.struct(F.size("_new").cast("bigint").alias("n_entities"), F.col("_kinds").alias("kinds")).alias("pii"),
    )
    return clean.unionByName(changed)
