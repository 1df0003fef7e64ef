"""PII surrogates: detected entities get keyed replacements of the same type and shape.

Detection, replacement and collision checks are DataFrame functions only.

- The same entity (an address in any case, a number in any punctuation) gets
  the same surrogate everywhere: a keyed SHA-256 of type and normal form.
- Surrogates keep the type: a phone number's country code and punctuation, a
  card's first digit and check digit, an address's shape, a name's script and
  the gender its title tells. Mail goes to reserved example domains.
- No two entities share a surrogate, and none is an entity of the corpus: those
  that collide are drawn again with the next attempt until none does.
- The words of names and the domains of mail addresses are entities of their
  own, so that each has one surrogate in every mention; made-up ones get longer
  with their number, and mailbox names with the attempt.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by_size, staged

#: Titles that come before a name, and the gender they tell.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "господин", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа", "г-жа"],
}
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
#: Syllables of surrogate names by script, and the endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he jo ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo za".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до жа за зе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то фа ха".split(),
}
#: Kinds of the words of names, with the gender of given names; and of all parts drawn as entities of their own.
WORDS = {"surname": None, "given-m": "m", "given-f": "f"}
PARTS = [*WORDS, "domain"]
#: Rounds without fewer collisions after which there can't be surrogates enough.
PATIENCE = 8
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "na", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Entity types in the order in which a place is tried for them.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "secret": r'(?<=")[0-9A-Fa-f]{32,64}(?=")',
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: ?\d{4}){3,7}(?: ?\d{1,3})?|(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "card": r"(?<![\d.\-])\d{4}(?:[ \-]?\d{4}){3}(?![\d\-])",
    "phone": r"\+\d{1,3}[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) \d{3}-\d{4}(?!\d)"
    r"|\+\d{1,3}(?:[ .\-]\(?\d{2,8}\)?){2,4}(?!\d)|(?<![\d.\-])(?:\d{3}-\d{3}-|\d{3}\.\d{3}\.)\d{4}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?![\p{{L}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A place that holds none of these holds no entity either.
HINT = rf'[0-9@]|(?:{_TITLE})'


#: The same patterns without what they look for around a place.
_BARE = {
    "email": PATTERNS["email"],
    "secret": "[0-9A-Fa-f]{32,64}",
    "iban": r"[A-Z]{2}\d{2}(?:(?: ?\d{4}){3,7}(?: ?\d{1,3})?|(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)",
    "card": r"\d{4}(?:[ \-]?\d{4}){3}",
    "phone": r"\+\d{1,3}[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\(\d{3}\) \d{3}-\d{4}|\+\d{1,3}(?:[ .\-]\(?\d{2,8}\)?){2,4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "name": rf"(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}


def kind_of(surface: Column) -> Column:
    """The type of a found string."""
    return F.coalesce(*(F.when(surface.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in _BARE.items()))


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits, modulo 10; 0 for a valid card number."""
    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(
        places, F.lit(0),
        lambda s, i: s + F.element_at(F.array(*(F.lit(x) for x in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9))),
                                      F.substring(digits, i, F.lit(1)).cast("int") + 1 + 10 * ((F.length(digits) - i) % 2)),
    ) % 10


def iban_rest(iban: Column) -> Column:
    """What a number without blanks leaves modulo 97, its first four characters moved to the end; 1 for a valid one."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.conv(c, 36, 10).cast("int")) % 97)


def _is_entity(kind: Column, surface: Column) -> Column:
    """Card numbers need a right check digit, bank accounts with letters right check digits, telephone numbers 8 to 15 digits."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    bank = F.regexp_replace(surface, " ", "")
    right = (
        F.when(kind == "card", luhn(digits) == 0)
        .when((kind == "iban") & F.substring(bank, F.lit(5), F.length(bank)).rlike("[A-Z]"), iban_rest(bank) == 1)
        .when(kind == "phone", F.length(digits).between(8, 15))
    )
    return kind.isNotNull() & F.coalesce(right, F.lit(True))


def found(text: Column) -> Column:
    """All candidate strings of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def normal(kind: Column, surface: Column) -> Column:
    """What mentions of one entity have in common: letters' case and punctuation don't count."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    # numbers of ten digits without a country's code are its, +1
    called = F.when((F.length(digits) == 10) & ~surface.startswith("+"), F.concat(F.lit("1"), digits)).otherwise(digits)
    return F.when(kind == "phone", called).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(surface, " ", "")).when(kind == "name", surface).otherwise(F.lower(surface))


def _hex(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hexadecimal digits, keyed."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")).cast("binary"), 256)
    return F.concat(h, F.sha2(F.concat(F.lit(key), h).cast("binary"), 256))


def _byte(h: Column, i: Column | int) -> Column:
    return F.conv(F.substring(h, 2 * (F.lit(i) if isinstance(i, int) else i) + 1, F.lit(2)), 16, 10).cast("int")


def _letters(h: Column, text: Column, from_: int = 0) -> Column:
    """Each letter of ``text`` replaced by a letter, each digit by a digit."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(h, (i + from_) % 60)
        return F.when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1))).when(c.rlike("[0-9]"), (b % 10).cast("string")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _syllables(n: int) -> int:
    """Syllables, three or more, that give at least as many names for each of ``n`` words as there are syllables."""
    pool, least = min(map(len, SYLLABLES.values())), 3
    while pool ** (least - 1) < n:
        least += 1
    return least


def _name(h: Column, word: Column, gender: str | None, syllables: int) -> Column:
    """A made-up name in the word's script: a given name with the gender's ending, else a surname."""
    def of(script: str) -> Column:
        pool = F.array(*(F.lit(x) for x in SYLLABLES[script]))
        at = 0 if gender else 8
        parts = [F.element_at(pool, _byte(h, at + i) % len(SYLLABLES[script]) + 1) for i in range(syllables)]
        return F.initcap(F.concat(*parts, F.lit(ENDINGS[script, gender] if gender else "")))

    return F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def canonical(key: str, kind: Column, norm: Column, attempt: Column, syllables: Mapping[str, int], host: Column) -> Column:
    """The surrogate's normal form for an entity's normal form; ``syllables`` of the kinds of parts, ``host`` of a mail address."""
    h = _hex(key, kind, norm, attempt)
    digits = F.translate(h, "abcdef", "270594")
    code = F.when(norm.startswith("1") & (F.length(norm) == 11), 1).otherwise(F.greatest(F.length(norm) - 10, F.lit(2)))
    phone = F.concat(F.substring(norm, F.lit(1), code), F.substring(digits, F.lit(1), F.length(norm) - code))
    body = F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(1), F.length(norm) - 2))
    card = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    ip = F.concat_ws(".", *((_byte(h, i) % 254 + 1).cast("string") for i in range(4)))
    # a mailbox gets one more letter with each attempt, so that a domain can't run out of them
    more = F.substring(F.translate(h, "0123456789", "ghijklmnop"), F.lit(1), attempt)
    email = F.concat(_letters(h, F.substring_index(norm, "@", 1)), more, F.lit("@"), host)
    top = F.when(F.substring_index(norm, ".", -1).isin("org", "net"), F.substring_index(norm, ".", -1)).otherwise(F.lit("com"))
    domain = F.concat(F.lower(_name(h, F.lit("a"), None, syllables.get("domain", 3))), F.lit(".example."), top)
    secret = F.substring(h, F.lit(1), F.length(norm))
    account = F.upper(_letters(h, F.lower(F.substring(norm, F.lit(5), F.length(norm)))))
    country = F.substring(norm, 1, 2)
    iban = F.concat(country, F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    ssn = F.concat(F.lit("9"), F.substring(digits, 1, 8))  # numbers that begin with 9 are not given out
    return (
        F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "email", email)
        .when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "ssn", ssn).when(kind == "domain", domain)
        .otherwise(F.coalesce(*(F.when(kind == k, _name(h, norm, gender, syllables.get(k, 3))) for k, gender in WORDS.items())))
    )


def name_words(names: DataFrame) -> DataFrame:
    """norm, title, given_kind, given (null without one) and surname of every name."""
    words = F.split("norm", " ")
    title = F.element_at(words, 1)
    male = title.isin(*(x for t in TITLES["m"] for x in (t, f"{t}.")))
    return names.select("norm", title.alias("title"), F.when(male, "given-m").otherwise("given-f").alias("given_kind"), F.when(F.size(words) > 2, F.element_at(words, 2)).alias("given"), F.element_at(words, -1).alias("surname"))


def reshape(kind: Column, surface: Column, form: Column) -> Column:
    """The surrogate in the shape of a mention: its punctuation and its case."""
    chars = F.split(surface, "")
    seen = lambda i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    count = F.length(F.regexp_replace(surface, "[^0-9A-Za-z]", ""))
    form = F.when(kind == "phone", F.right(form, count)).otherwise(form)
    numbered = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(form, seen(i), F.lit(1))).otherwise(c)), "")
    upper = surface == F.upper(surface)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), numbered).when(kind.isin("email", "secret") & upper, F.upper(form)).otherwise(form)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm → form: distinct, and no entity's own, by drawing collisions again.

    Words of names and domains are drawn as entities of their own, and names
    and addresses are put together from them: as no two words share a
    surrogate and none is a word of a name in the corpus, the same holds for
    names.
    """
    all_ = staged(entities.select("kind", "norm").distinct(), "entities")
    names = name_words(all_.where("kind = 'name'"))
    words = names.select(F.lit("surname").alias("kind"), F.col("surname").alias("norm")).unionByName(names.where("given IS NOT NULL").select(F.col("given_kind").alias("kind"), F.col("given").alias("norm")))
    mail = all_.where("kind = 'email'").withColumn("domain", F.substring_index("norm", "@", -1))
    none = F.lit(None).cast("string").alias("host")
    parts = drawn(words.unionByName(mail.select(F.lit("domain").alias("kind"), F.col("domain").alias("norm"))).distinct().select("kind", "norm", none), key)
    hosts = parts.where("kind = 'domain'").select(F.col("norm").alias("domain"), F.col("form").alias("host"))
    mailed = joined_by_size(mail, hosts.join(mail.groupBy("domain").agg(F.count("*").alias("n")), "domain"), "domain", "n").select("kind", "norm", "host")
    forms = drawn(all_.where("kind NOT IN ('name', 'email')").select("kind", "norm", none).unionByName(mailed), key)
    last = parts.where("kind = 'surname'").select(F.col("norm").alias("surname"), F.col("form").alias("last"))
    first = parts.select(F.col("kind").alias("given_kind"), F.col("norm").alias("given"), F.col("form").alias("first"))
    made = names.join(last, "surname").join(first, ["given_kind", "given"], "left")
    made = made.select(F.lit("name").alias("kind"), "norm", F.concat_ws(" ", "title", "first", "last").alias("form"))
    return forms.unionByName(made)


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm → form of entities and parts (kind, norm, host): distinct in each kind, and none that is there.

    Each round's table is written to the shared folder; a round draws only
    those that collided, of which fewer are left each time. Where that ends -
    more entities than the type has values - an error says so.
    """
    known = staged(entities, "known")
    counts = {r["kind"]: _syllables(r["count"]) for r in known.where(F.col("kind").isin(*PARTS)).groupBy("kind").count().collect()}
    name = lambda df: df.withColumn("form", canonical(key, F.col("kind"), F.col("norm"), F.col("attempt"), counts, F.col("host")))
    now = staged(name(known.withColumn("attempt", F.lit(0))), "surrogates")
    fewest, waited = None, 0
    while True:
        shared = now.groupBy("kind", "form").agg(F.min("norm").alias("first"), F.count("*").alias("n")).where("n > 1")
        taken = now.join(shared, ["kind", "form"]).where("norm <> first").select("kind", "norm")
        real = now.join(known.select("kind", F.col("norm").alias("form")), ["kind", "form"], "left_semi").select("kind", "norm")
        again = staged(taken.unionByName(real).distinct(), "again")
        if not (n := again.count()):
            return now.select("kind", "norm", "form")
        waited = 0 if fewest is None or n < fewest else waited + 1
        fewest = n if fewest is None else min(n, fewest)
        if waited > PATIENCE:
            raise ValueError(f"no surrogates left for {n} entities, of kinds {[r['kind'] for r in again.select('kind').distinct().collect()]}")
        redrawn = now.join(again, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        after = staged(now.join(again, ["kind", "norm"], "left_anti").unionByName(name(redrawn)), "surrogates")
        discard(now)
        now = after


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds of every row.

    Found are mail addresses, quoted secrets of 32 to 64 hexadecimal digits,
    bank accounts, cards of sixteen digits, telephone numbers with a country's
    code or in American form, social security numbers, IPv4 addresses, and
    names after a title; names without one, IPv6 addresses and other secrets
    are not. Very long texts are read whole. Null texts stay null; texts without entities stay as they are. Repeated
    rows have a row each, null ids pass through, an empty table gives no rows.
    Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    may = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False))
    plain = rows.where(~may).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"), F.lit("").alias("kinds"))
    # the texts that hold something, once: they are a few of all
    held = staged(rows.where(may).withColumn("th", F.xxhash64("text")), "held")
    places = held.select("doc_id", "th", "text").distinct().select("doc_id", "th", F.posexplode(found(F.col("text"))).alias("at", "surface"))
    kind = kind_of(F.col("surface"))
    places = places.withColumn("kind", kind).where(_is_entity(F.col("kind"), F.col("surface"))).withColumn("norm", normal(F.col("kind"), F.col("surface")))
    places = staged(places, "places")
    forms = surrogates(places, key)
    # an address may stand in a third of all documents
    entity = F.struct("kind", "norm").alias("entity")
    sizes = places.groupBy(entity).agg(F.count("*").alias("n"))
    formed = staged(forms.select(entity, "form").join(sizes, "entity"), "formed")
    named = joined_by_size(places.withColumn("entity", entity), formed, "entity", "n").select("doc_id", "th", "at", "kind", reshape(F.col("kind"), F.col("surface"), F.col("form")).alias("new"))
    by = named.groupBy(F.col("doc_id").alias("__i"), F.col("th").alias("__t")).agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("new"), F.count("*").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    joined = held.join(by, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__t")), "left")
    old, gaps = found(F.col("text")), F.split("text", ANY, -1)
    between = F.transform(old, lambda x, i: F.coalesce(F.try_element_at(F.col("new"), i), x))
    text = F.array_join(F.flatten(F.zip_with(gaps, F.array_append(between, F.lit("")), lambda g, x: F.array(g, x))), "")
    return plain.unionByName(joined.select("doc_id", text.alias("text"), F.coalesce("n_entities", F.lit(0)).cast("bigint").alias("n_entities"), F.coalesce("kinds", F.lit("")).alias("kinds")))


#: The key of the registered query; a deployment passes its own.
QUERY_KEY = "tidemark"


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
