"""Personal data replaced by surrogates (operator 5), in DataFrame functions only.

One regular expression finds e-mail and IP addresses, card, bank, social-security and phone numbers, and
names: up to four words after a title, or after a usual given name. A surrogate depends on a secret key, the
kind and the entity's canonical form (digits alone, letters in lower case), so that all mentions of an entity,
in whatever format, get the same one, in the mention's own format:

* numbers: a keyed permutation of the digit strings of equal length (a Feistel network on two halves);
  punctuation and country code are kept, and so is whether the check digits are right;
* e-mail addresses: keyed letters and digits in the same places; a domain keeps its number of labels;
* names: each word by itself, so that a surname alone goes with the full name; keyed syllables, given names
  with the ending of the title's gender, in the script of the name. A word of a found name that stands
  elsewhere in the same text, without a title, is replaced as well.

Steps: mentions are found in one pass; distinct mentions give distinct entities, which are dealt out evenly;
each kind of entity is computed for its own rows only. Then all entities of the corpus are checked: where two
share a surrogate, or a surrogate is an entity of the corpus itself, another attempt is made until none is
left (later attempts have longer names and labels, so there is always room). The surrogates of a text's
mentions are gathered by text, in order, and put between what the expression leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoplake.llm.common import discard, materialise

#: The setting that names the secret key, and the key of a session without one, which keeps nothing secret.
KEY_SETTING, DEFAULT_KEY = "spark.stoplake.surrogates.key", "stoplake surrogate key"
#: Fixed patterns, tried in this order at each place.
MALE = r"Mr|Herr|Monsieur|Señor|Sr|Signor|г-н"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|г-жа"
OTHER = r"Dr|Prof|Doctor|Professor"
TITLE = rf"(?:{MALE}|{FEMALE}|{OTHER})\.? "
#: Usual given names, which begin a name without a title.
MEN = "Adam Ahmed Ali Andrew Anthony Carlos Charles Christopher Daniel David Dmitri Edward Francesco George Giovanni Hans Ivan James Jan Jean John Jorge José Joseph Juan Klaus Luis Marco Michael Mohammed Nikolai Paul Pedro Peter Pierre Richard Robert Sergei Thomas William".split()
WOMEN = "Alice Amanda Anna Barbara Carmen Catherine Claire Elena Elizabeth Emily Emma Eva Fatima Francesca Giulia Helen Ingrid Irina Jane Jennifer Jessica Julia Karen Laura Linda Lucia Maria Marie Mary Natalia Olga Patricia Rosa Sarah Sofia Sophie Susan Svetlana Teresa Ursula".split()
# Repeats of groups are bounded and those of characters possessive where nothing is given back, so that no run of
# characters, however long, takes the matcher's stack or a time that grows with its square.
NAME_WORD = r"\p{Lu}(?:[\p{L}'’]*\p{L})(?:-\p{Lu}[\p{L}'’]*\p{L}){0,7}"
PARTICLE = r"(?:van der|van den|von der|de la|van|von|de|del|di|da|dos|la|le|bin|al) "
NAME = rf"(?:{PARTICLE})?{NAME_WORD}"
PATTERNS = {
    # a local part has 64 characters at most, so 32 parts; a domain 127 labels
    "email": r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++){0,31}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{0,4}[0-9]{7}[A-Z0-9]{0,19})(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+(?=(?:[ .-]?[0-9]){8,15}(?![ .-]?[0-9]))[0-9]{1,3}(?:[ .-][0-9]{2,10}){1,5}(?![0-9])|(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|\+[0-9]{9,15}(?![0-9])|(?<![0-9-])(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])|(?<![0-9-]|[0-9] )[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![0-9-]| [0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{TITLE}(?:\p{{Lu}}\. ){{0,2}}{NAME}(?: (?:\p{{Lu}}\. )?{NAME}){{0,2}}|(?:{'|'.join(MEN + WOMEN)}) (?:\p{{Lu}}\. )?{NAME}(?: {NAME_WORD})?)(?![\p{{L}}\p{{N}}])",
}
PII = "|".join(f"(?:{p})" for p in PATTERNS.values())
TOKEN = rf"(?<![\p{{L}}\p{{N}}]){NAME_WORD}(?![\p{{L}}\p{{N}}])"
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Labels of a domain that stay, besides the last one.
PUBLIC_LABELS = ["co", "com", "org", "net", "ac", "edu", "gov", "example"]
#: Syllables of surrogate names, by script.
LATIN = "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se".split()
CYRILLIC = "ба бе бо да де до фа фе га го ка ке ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се".split()
GREEK = "βα βε βο δα δε δο φα φε γα γο κα κε λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε".split()
#: Syllables of a family name in the first attempt, and at most.
SYLLABLES, MOST_SYLLABLES = 4, 12


def digest(*parts: Column) -> Column:
    """A keyed digest; rows have the key in a column of its own."""
    return F.sha2(F.concat_ws("|", F.col("_key"), *parts), 256)


def number_of(hexes: Column, at: int = 1, width: int = 14) -> Column:
    return F.conv(F.substring(hexes, at, width), 16, 10).cast("long")


def permuted(rows: DataFrame, kind: str) -> DataFrame:
    """rows with digits replaced by a keyed permutation of the digit strings of their length (up to 36).

    Four Feistel half rounds; each half is a column of its own, so that it is computed once.
    """
    n = F.length("digits")
    u = (n / 2).cast("int")
    rows = rows.withColumns({"_u": u, "_v": n - u, "_a": F.substr("digits", F.lit(1), u), "_b": F.substr("digits", u + 1, n)})
    for r in range(2):
        for half, other, width in (("_a", "_b", "_u"), ("_b", "_a", "_v")):
            by = number_of(digest(F.lit(kind), n.cast("string"), F.col("attempt").cast("string"), F.lit(f"{half[1]}{r}"), F.col(other))).cast("decimal(20,0)")
            size = F.pow(F.lit(10), F.col(width)).cast("decimal(20,0)")
            moved = ((F.col(half).cast("decimal(20,0)") + by) % size).cast("decimal(20,0)").cast("string")
            rows = rows.withColumn(half, F.when(F.col(width) == 0, F.lit("")).otherwise(F.lpad(moved, F.col(width), F.lit("0"))))
    return rows.withColumn("digits", F.concat("_a", "_b")).drop("_u", "_v", "_a", "_b")


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def in_format(mention: Column, made: Column) -> Column:
    """mention with its ASCII letters and digits replaced, one after the other, by the characters of made."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        taken = c.rlike("^[0-9A-Za-z]$")
        return F.struct(F.concat(acc["out"], F.when(taken, F.substr(made, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + taken.cast("int")).alias("k"))

    return F.aggregate(F.split(mention, ""), start, put, lambda acc: acc["out"])


def luhn_digit(body: Column) -> Column:
    """The check digit that belongs after the digits of body."""
    n = F.length(body)
    each = F.transform(F.split(body, ""), lambda c, i: _luhn(c.cast("int"), (n - i) % 2 == 1))
    return ((10 - F.aggregate(each, F.lit(0), lambda x, y: x + y) % 10) % 10).cast("int")


def _luhn(d: Column, doubled: Column) -> Column:
    return F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an account number, by the remainder modulo 97."""
    whole = F.split(F.concat(account, country, F.lit("00")), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(whole, F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return (98 - rest).cast("int")


def letters_like(text: Column, seed: Column) -> Column:
    """Keyed letters and digits in the places of those of text, case and punctuation kept."""
    long_seed = F.concat(seed, F.sha2(seed, 256))

    def put(c: Column, i: Column) -> Column:
        v = F.conv(F.substr(long_seed, (2 * i) % 126 + 1, F.lit(2)), 16, 10).cast("int")
        return F.when(c.between("0", "9"), (v % 10).cast("string")).when(c.between("a", "z"), F.char(v % 26 + 97)).when(c.between("A", "Z"), F.char(v % 26 + 65)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), put), "")


def kind_of(x: Column) -> Column:
    """The kind of a mention that the expression found."""
    digits = F.length(only_digits(x))
    return (
        F.when(F.contains(x, F.lit("@")), "email")
        .when(x.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(F.contains(x, F.lit(":")), "ip6")
        .when(x.rlike(r"^[A-Z]{2}[0-9]{2}[ A-Z0-9]*$"), "iban")
        .when(x.rlike(r"^\p{L}"), "name")
        .when(x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when((digits >= 13) & x.rlike(r"^[0-9 -]+$"), "card")
        .otherwise("phone")
    )


def canonical(x: Column, kind: Column) -> Column:
    """What all mentions of an entity have in common; of a name, the words. Numbers of the country code 1 are the same without it."""
    abroad = (kind == "phone") & x.startswith("+") & ~x.startswith("+1")
    return F.when(kind.isin("email", "ip6"), F.lower(x)).when(kind == "ip", x).when(kind == "name", x).when(kind == "iban", F.replace(x, F.lit(" "), F.lit(""))).when(abroad, F.concat(F.lit("+"), only_digits(x))).otherwise(only_digits(x))


def gender(x: Column) -> Column:
    """f, m or n by the title of a name, or by the given name without one."""
    first = F.substring_index(x, " ", 1)
    return F.when(x.rlike(rf"^(?:{FEMALE})\b") | first.isin(WOMEN), "f").when(x.rlike(rf"^(?:{MALE})\b") | first.isin(MEN), "m").otherwise("n")


def script_of(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}{2}"), "c").when(x.rlike(r"\p{IsGreek}{2}"), "g").otherwise("l")


def spoken(seed: Column, script: Column, syllables: Column, most: int) -> Column:
    """The first syllables of a keyed series of at most most."""

    def word(table: list[str]) -> Column:
        names = F.array(*[F.lit(s) for s in table])
        return F.concat(*[F.when(syllables > k, F.get(names, (number_of(seed, 1 + 2 * k, 2) % len(table)).cast("int"))).otherwise(F.lit("")) for k in range(most)])

    return F.when(script == "c", word(CYRILLIC)).when(script == "g", word(GREEK)).otherwise(word(LATIN))


# One function for each kind of entity: rows(form, attempt) with the surrogate in the column made.


def _email(rows: DataFrame) -> DataFrame:
    """The local part; the domain is an entity of its own."""
    local, domain = F.substring_index("form", "@", 1), F.substring_index("form", "@", -1)
    seed = digest(F.lit("local"), local, domain, F.col("attempt").cast("string"))
    return rows.withColumn("made", F.concat(letters_like(F.concat(local, F.repeat(F.lit("a"), F.col("attempt"))), seed), F.lit("@"), domain))


def _domain(rows: DataFrame) -> DataFrame:
    """Keyed letters in each label but the last and those that many domains have; the first one always."""
    seed, labels = digest(F.lit("domain"), F.col("form"), F.col("attempt").cast("string")), F.split("form", "\\.")

    def put(x: Column, i: Column) -> Column:
        stays = (i == F.size(labels) - 1) | ((i > 0) & x.isin(PUBLIC_LABELS))
        more = F.when(i == 0, F.repeat(F.lit("a"), F.col("attempt"))).otherwise(F.lit(""))
        return F.when(stays, x).otherwise(letters_like(F.concat(x, more), F.sha2(F.concat(seed, i.cast("string")), 256)))

    return rows.withColumn("made", F.array_join(F.transform(labels, put), "."))


def _ip(rows: DataFrame) -> DataFrame:
    """A keyed permutation of the two 16-bit halves."""
    o = [F.get(F.split("form", "\\."), k).cast("int") for k in range(4)]
    rows = rows.withColumns({"_a": (o[0] * 256 + o[1]) % 65536, "_b": (o[2] * 256 + o[3]) % 65536})
    for r in range(2):
        for half, other in (("_a", "_b"), ("_b", "_a")):
            by = number_of(digest(F.lit("ip"), F.col("attempt").cast("string"), F.lit(f"{half}{r}"), F.col(other).cast("string")))
            rows = rows.withColumn(half, ((F.col(half) + by) % 65536).cast("int"))
    parts = (F.floor(F.col("_a") / 256), F.col("_a") % 256, F.floor(F.col("_b") / 256), F.col("_b") % 256)
    return rows.withColumn("made", F.concat_ws(".", *[v.cast("int").cast("string") for v in parts])).drop("_a", "_b")


def _ip6(rows: DataFrame) -> DataFrame:
    """Keyed hexadecimal digits in the same places; the first of a group is not 0."""
    seed = digest(F.lit("ip6"), F.col("form"), F.col("attempt").cast("string"))
    chars = F.split("form", "")

    def put(c: Column, i: Column) -> Column:
        v = F.conv(F.substr(seed, i + 1, F.lit(1)), 16, 10).cast("int")
        first = (i == 0) | (F.get(chars, i - 1) == ":")
        return F.when(c == ":", c).otherwise(F.lower(F.hex(F.when(first, v % 15 + 1).otherwise(v).cast("long"))))

    return rows.withColumn("made", F.array_join(F.transform(chars, put), ""))


def _card(rows: DataFrame) -> DataFrame:
    """The first digit stays, and so does how far the check digit is from the right one."""
    n = F.length("form")
    rows = rows.withColumn("digits", F.substr("form", F.lit(2), n - 2))
    rows = permuted(rows, "card").withColumn("_body", F.concat(F.substring("form", 1, 1), F.col("digits")))
    rows = rows.withColumns({"_off": (F.substring("form", -1, 1).cast("int") - luhn_digit(F.substr("form", F.lit(1), n - 1)) + 10) % 10, "_right": luhn_digit(F.col("_body"))})
    return rows.withColumn("made", F.concat("_body", ((F.col("_right") + F.col("_off")) % 10).cast("string"))).drop("_body", "_off", "_right", "digits")


def _iban(rows: DataFrame) -> DataFrame:
    """Country and form of the account number stay, and so does whether the check digits are right."""
    country, check, account = F.substring("form", 1, 2), F.substring("form", 3, 2).cast("int"), F.substr("form", F.lit(5), F.length("form"))
    rows = rows.withColumns({"_off": (check - iban_check(country, account) + 97) % 97, "digits": only_digits(account)})
    rows = permuted(rows, "iban")
    letters = letters_like(F.regexp_replace(account, "[0-9]", ""), digest(F.lit("iban"), F.col("form"), F.col("attempt").cast("string")))
    rows = rows.withColumn("_letters", letters)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("d"), F.lit(0).alias("l"))

    def put(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        taken = F.when(digit, F.substr("digits", acc["d"] + 1, F.lit(1))).otherwise(F.substr("_letters", acc["l"] + 1, F.lit(1)))
        return F.struct(F.concat(acc["out"], taken).alias("out"), (acc["d"] + digit.cast("int")).alias("d"), (acc["l"] + (~digit).cast("int")).alias("l"))

    rows = rows.withColumn("_account", F.aggregate(F.split(account, ""), start, put, lambda acc: acc["out"]))
    # 2 to 98 are the check digits that can be right
    new = (iban_check(country, F.col("_account")) - 2 + F.col("_off")) % 97 + 2
    return rows.withColumn("made", F.concat(country, F.lpad(new.cast("string"), 2, "0"), F.col("_account"))).drop("_off", "digits", "_letters", "_account")


def _ssn(rows: DataFrame) -> DataFrame:
    return permuted(rows.withColumn("digits", F.col("form")), "ssn").withColumn("made", F.col("digits")).drop("digits")


def _phone(rows: DataFrame) -> DataFrame:
    """The country code stays: what stands for one after a plus, else all but the last ten digits."""
    ahead = F.when(F.col("form").startswith("+"), F.length(F.regexp_extract("form", COUNTRY, 0))).otherwise(F.greatest(F.length("form") - 10, F.lit(0)))
    rows = permuted(rows.withColumns({"_ahead": F.substr("form", F.lit(1), ahead), "digits": F.substr("form", ahead + 1, F.length("form"))}), "phone")
    return rows.withColumn("made", F.concat("_ahead", "digits")).drop("_ahead", "digits")


def _family(rows: DataFrame) -> DataFrame:
    seed = digest(F.lit("family"), F.col("form"), F.col("attempt").cast("string"))
    return rows.withColumn("made", spoken(seed, script_of(F.col("form")), SYLLABLES + F.col("attempt"), MOST_SYLLABLES))


def _given(rows: DataFrame) -> DataFrame:
    """form: gender, blank, word."""
    g, script = F.substring("form", 1, 1), script_of(F.col("form"))
    seed = digest(F.lit("given"), F.col("form"), F.col("attempt").cast("string"))
    ending = F.when(g == "f", F.when(script == "c", "на").when(script == "g", "να").otherwise("na")).when(g == "m", F.when(script == "c", "н").when(script == "g", "ν").otherwise("n")).otherwise(F.lit(""))
    return rows.withColumn("made", F.concat(g, F.lit(" "), spoken(seed, script, 2 + F.col("attempt"), MOST_SYLLABLES), ending))


KINDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "email": _email, "domain": _domain, "ip": _ip, "ip6": _ip6, "card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "family": _family, "given": _given,
}


def surrogates(rows: DataFrame, key: str) -> DataFrame:
    """rows(kind, form, attempt) with the surrogate form in made, each kind computed for its own rows only."""
    rows = rows.withColumn("_key", F.lit(key))
    each = [f(rows.filter(F.col("kind") == kind)).select("kind", "form", "attempt", "made") for kind, f in KINDS.items()]
    return reduce(DataFrame.unionAll, each)


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PII), F.lit(0))


def name_words(names: DataFrame) -> DataFrame:
    """mention, k, word, kind (family or given) and form of the words of names(mention); initials and particles are none."""
    bare = F.regexp_replace("mention", rf"^{TITLE}", "")
    rows = names.withColumns({"_g": gender(F.col("mention")), "_w": F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0))})
    rows = rows.select("mention", "_g", F.size("_w").alias("_n"), F.posexplode("_w").alias("k", "word")).filter(~F.col("word").rlike(r"^\p{Lu}$"))
    family = F.col("k") == F.col("_n") - 1
    return rows.select("mention", "k", "word", F.when(family, "family").otherwise("given").alias("kind"), F.when(family, F.lower("word")).otherwise(F.concat("_g", F.lit(" "), F.lower("word"))).alias("form"))


def entities(each: DataFrame) -> DataFrame:
    """Distinct kind and form of all entities of distinct mentions(mention, kind, form)."""
    numbers = each.filter("kind <> 'name'").select("kind", "form")
    domains = each.filter("kind = 'email'").select(F.lit("domain").alias("kind"), F.substring_index("form", "@", -1).alias("form"))
    return numbers.unionAll(domains).unionAll(name_words(each.filter("kind = 'name'")).select("kind", "form")).distinct()


def resolved(found: DataFrame, key: str) -> DataFrame:
    """kind, form and made of all entities(kind, form): no two of a kind share a surrogate, and none is an entity."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = materialise(found.repartition(n, "kind", "form"), "entities")
    made = materialise(surrogates(real.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        shared = made.groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        # clashes are few: only they meet the window; the first of them stays
        clash = made.join(shared, ["kind", "made"]).withColumn("k", F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "form"))).filter("k > 1").select("kind", "form", "attempt")
        taken = made.join(real.select("kind", F.col("form").alias("made")), ["kind", "made"], "left_semi").select("kind", "form", "attempt")
        moved = materialise(clash.unionAll(taken).distinct(), "moved")
        if moved.isEmpty():
            discard(moved)
            discard(real)
            return made
        again = surrogates(moved.withColumn("attempt", F.col("attempt") + 1).repartition(n, "kind", "form"), key)
        new = materialise(made.join(moved.select("kind", "form"), ["kind", "form"], "left_anti").select("kind", "form", "attempt", "made").unionAll(again), "surrogates")
        discard(made)
        discard(moved)
        made = new


def in_place(each: DataFrame, made: DataFrame) -> DataFrame:
    """mention and its replacement, for distinct mentions(mention, kind, form) and the entities' surrogates."""
    numbers = each.filter("kind not in ('name', 'email')").join(made, ["kind", "form"])
    numbers = numbers.select("mention", F.when(F.col("kind").isin("ip", "ip6"), F.col("made")).otherwise(in_format(F.col("mention"), F.ltrim("made", F.lit("+")))).alias("put"))
    own = made.filter("kind = 'email'").select("form", F.substring_index("made", "@", 1).alias("local"))
    domain = made.filter("kind = 'domain'").select(F.col("form").alias("domain"), F.col("made").alias("new_domain"))
    mails = each.filter("kind = 'email'").join(own, "form").withColumn("domain", F.substring_index("form", "@", -1)).join(domain, "domain")
    mails = mails.select("mention", F.concat("local", F.lit("@"), "new_domain").alias("put"))
    words = spelled(each, made).groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("k", "new"))).alias("w"))
    bare = F.regexp_replace("mention", rf"^{TITLE}", "")
    title = F.substr("mention", F.lit(1), F.length("mention") - F.length(bare))
    # an initial becomes another one; particles stay; each remaining word takes the next surrogate
    pieces, rest = F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0)), F.split(bare, TOKEN, -1)
    by_place = F.map_from_entries(F.transform("w", lambda x: F.struct(x["k"], x["new"])))
    put = F.transform(pieces, lambda x, i: F.coalesce(F.try_element_at(by_place, i), x))
    between = F.transform(rest, lambda x: F.regexp_replace(x, r"\p{Lu}(?=\.)", "X"))
    both = F.zip_with(between, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    names = each.filter("kind = 'name'").join(words, "mention", "left").select("mention", F.coalesce(F.concat(title, F.array_join(both, "")), F.col("mention")).alias("put"))
    return numbers.unionAll(mails).unionAll(names)


def spelled(each: DataFrame, made: DataFrame) -> DataFrame:
    """mention, k, word and new of the words of names: surrogates with a capital."""
    made = made.filter("kind in ('family', 'given')")
    new = F.initcap(F.regexp_replace("made", "^[fmn] ", ""))
    return name_words(each.filter("kind = 'name'")).join(made, ["kind", "form"]).select("mention", "k", "word", new.alias("new"))


def replaced(text: Column, put: Column, words: Column) -> Column:
    """text with its mentions replaced by put, in order, and in between words by the map words."""
    rest = F.split(text, PII, -1)

    def other(x: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), lambda t: F.coalesce(F.try_element_at(words, t), t))
        return F.array_join(F.zip_with(F.split(x, TOKEN, -1), tokens, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    rest = F.when(F.size(words) > 0, F.transform(rest, other)).otherwise(rest)
    return F.array_join(F.zip_with(rest, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def by_text(docs: DataFrame, key: str) -> DataFrame:
    """copy (md5 of a text), put (what replaces its mentions, in order) and words (map of name words), for texts with mentions."""
    found = docs.select(F.md5("text").alias("copy"), F.posexplode(mentions(F.col("text"))).alias("k", "mention"))
    found = materialise(found.distinct(), "mentions")  # equal texts have equal mentions
    kind = kind_of(F.col("mention"))
    each = materialise(found.select("mention").distinct().select("mention", kind.alias("kind"), canonical(F.col("mention"), kind).alias("form")), "distinct-mentions")
    made = resolved(entities(each), key)
    put = materialise(in_place(each, made), "replacements")
    words = materialise(spelled(each, made).select("mention", "word", "new").distinct(), "words")
    lists = found.join(put, "mention").groupBy("copy").agg(F.sort_array(F.collect_list(F.struct("k", "put"))).alias("_l"))
    named = found.join(words, "mention").groupBy("copy", "word").agg(F.min("new").alias("new")).groupBy("copy").agg(F.map_from_entries(F.collect_list(F.struct("word", "new"))).alias("words"))
    none = F.create_map().cast("map<string,string>")
    out = lists.join(named, "copy", "left").select("copy", F.transform("_l", lambda x: x["put"]).alias("put"), F.coalesce("words", none).alias("words"))
    out = materialise(out, "by-text")
    for x in (found, each, made, put, words):
        discard(x)
    return out


def protect(docs: DataFrame, count: str | None = "n_entities", key: str | None = None) -> DataFrame:
    """docs with surrogates in text and, in the column named by count, the number of mentions that the expression finds.

    key: the secret that surrogates depend on; without one, the session's setting spark.stoplake.surrogates.key. Texts
    of any length are searched as a whole, in a time in proportion to it.

    A column of that name is replaced; all others stay, whatever their names, as do all if count is None. A
    null text stays null with 0 entities; rows that repeat stay alike. An empty table gives an empty one.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, DEFAULT_KEY)
    maps = by_text(docs.select("text"), key).select("copy", F.struct("put", "words").alias("new"))
    names = [c for c in docs.columns if c != count]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.md5("text").alias("copy"))
    # both sides grow with the corpus: one way of joining for every size, which Spark can split where copies are hot
    joined = held.join(maps.hint("merge"), "copy", "left")
    text = F.when(F.col("new").isNull(), F.col("row.text")).otherwise(replaced(F.col("row.text"), F.col("new.put"), F.col("new.words")))
    out = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    found = F.when(F.col("new").isNull(), F.lit(0)).otherwise(F.size("new.put"))
    return joined.select(*out, *([] if count is None else [found.alias(count)]))
