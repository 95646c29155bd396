"""Personal data: entities are replaced by keyed, type-consistent surrogates.

Detected are e-mail addresses, phone numbers, IPv4 addresses, payment-card and
account numbers, social-security numbers and names after a title; of these, all parts, and
further mentions of the parts in the same document without a title. Persons
who have no title anywhere in a document are not detected. A part of a name has
one role (first name or last) in a document. A mention is reduced to its
entity (an address in lower case, the digits of a number, of a phone number without its
country code, which stays, each part of a name), and each distinct entity gets one surrogate everywhere, so coreference
holds across documents. A surrogate is drawn from a keyed hash and poured into
the entity's form: letters stay letters of the same script and case, digits
stay digits, card numbers keep their check-sum property, private addresses
stay private, first names keep the gender that the title shows, addresses their
pattern of capitals. Letters of other scripts than Latin, Cyrillic and Greek are poured as Latin. Candidates
that equal another candidate, an accepted surrogate or any entity found are
rejected and drawn again, so distinct entities stay distinct; mailboxes need
to differ only within their domain. Later rounds lengthen what can be
lengthened (mailboxes, domains, phone numbers, names) and take 192.168
addresses to network 10. What the rounds leave gets the free values of its
form by rank; it is an error only if a form has fewer free values than entities.

Only built-in functions run. What is shuffled: one row per distinct entity
and partition, and the pieces of those texts that have mentions. Mentions are salted when
they meet their surrogate, so an entity in very many texts is spread out.

Results: null texts stay null and empty ones empty; texts without mentions
stay as they are; repeated rows are replaced alike; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, let, once, written

# Titles that show a gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа", "Κυρία")
#: Titles that show none.
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor")
TITLES = sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)
TITLED = rf"(?:(?:{'|'.join(TITLES)})\.? )"

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kinds in the order in which they are tried at a place.
KINDS = {
    "email": r"[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "name": rf"(?<!\p{{L}}){TITLED}+\p{{Lu}}[\p{{L}}\p{{M}}'-]+(?: \p{{Lu}}[\p{{L}}\p{{M}}'-]+)*",
}
ANY = f"({'|'.join(KINDS.values())})"

# Country codes of one and of two digits; the others have three.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Letters that pour into a form, by script.
LETTERS = {"latin": "abcdefghijklmnoprstuvwyz", "cyrillic": "абвгдежзиклмнопрстуфхцчш", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Syllables of names and their endings by gender, by script.
SYLLABLES = {"latin": "ba be da do ga ka ko la le li ma me mi na no ra re ri sa ta to va ve zo", "cyrillic": "ба бе да до га ка ко ла ле ли ма ме ми на но ра ре ри са та то ва ве зо", "greek": "βα βε δα δο γα κα κο λα λε λι μα με μι να νο ρα ρε ρι σα τα το πα πε ζο"}
ENDINGS = {"latin": {"m": "n", "f": "na", "u": "l", "last": "rt"}, "cyrillic": {"m": "н", "f": "на", "u": "л", "last": "ров"}, "greek": {"m": "νος", "f": "να", "u": "λι", "last": "κης"}}


#: The attempts from which a form grows by a digit each, and from which 192.168 addresses go to network 10.
LONGER, WIDER = 3, 6


def may_have(text: Column) -> Column:
    """A cheap test that every text with a mention passes: each kind has a digit, an @ or a title."""
    some = F.contains(text, F.lit("@")) | text.rlike("[0-9]")
    for title in TITLES:
        some = some | F.contains(text, F.lit(f"{title} ")) | F.contains(text, F.lit(f"{title}. "))
    return some


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern matches the whole mention."""
    out = F.when(mention.rlike(r"^\p{L}"), "name").otherwise("phone")  # a part of a name that has no title
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def parts_of(mention: Column) -> Column:
    """The parts of a name without its titles."""
    return F.split(F.regexp_replace(mention, f"^{TITLED}+", ""), " ")


def key_of(part: Column) -> Column:
    """A part of a name in lower case, without a genitive."""
    return F.regexp_replace(F.lower(part), "'s?$", "")


def roles_of(mentions: Column) -> Column:
    """The kind of each part of the names in a document's mentions, by its key; mentions of several parts tell first names from last."""
    names = F.filter(mentions, lambda m: m.rlike(f"^{TITLED}"))

    def of(m: Column) -> Column:
        lead = F.regexp_extract(m, f"^{TITLED}+", 0)
        has = lambda titles: lead.rlike(rf"(?<!\p{{L}})(?:{'|'.join(titles)})\.? ")
        first = F.when(has(FEMALE), "first-f").when(has(MALE), "first-m").otherwise("first-u")
        return let(parts_of(m), lambda p: F.transform(p, lambda x, i: F.struct(key_of(x).alias("part"), F.when(i < F.size(p) - 1, first).otherwise("last").alias("kind"))))

    def first_of(all_: Column) -> Column:
        keys = F.transform(all_, lambda x: x["part"])
        return let(keys, lambda k: let(F.array_distinct(k), lambda d: F.map_from_arrays(d, F.transform(d, lambda x: F.get(all_, (F.array_position(k, x) - 1).cast("int"))["kind"]))))

    each = F.transform(F.array_distinct(names), of)
    return let(each, lambda e: let(F.flatten(F.concat(F.filter(e, lambda x: F.size(x) > 1), F.filter(e, lambda x: F.size(x) == 1))), first_of))


def pattern_of(roles: Column) -> Column:
    """ANY, and runs of the parts of a document's names, capitalised or all in capitals."""
    shown = F.flatten(F.transform(F.array_sort(F.map_keys(roles), lambda a, b: F.length(b) - F.length(a)), lambda k: F.array(F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, 2, 1000)), F.initcap(k), F.regexp_replace(F.initcap(F.regexp_replace(k, "(['-])", "$1 ")), "(['-]) ", "$1"), F.upper(k))))
    one = F.concat(F.lit("(?:"), F.array_join(F.array_distinct(shown), "|"), F.lit(r")(?![\p{L}\p{M}])"))
    return F.when(F.size(roles) == 0, F.lit(ANY)).otherwise(F.concat(F.lit(ANY[:-1] + r"|(?<![\p{L}\p{M}])"), one, F.lit("(?: "), one, F.lit(")*)")))


def entities(mention: Column, kind: Column, roles: Column) -> Column:
    """The entities of a mention: structs of kind and normal form. ``roles``: those of the document's names."""
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("entity"))
    named = F.transform(F.transform(parts_of(mention), key_of), lambda k: one(F.coalesce(F.try_element_at(roles, k), F.lit("last")), k))
    address = F.lower(mention)
    return (
        F.when(kind == "name", named)
        .when(kind == "email", F.array(one(F.lit("mailbox"), address), one(F.lit("domain"), F.substring_index(address, "@", -1))))
        .when(kind == "phone", F.array(one(kind, digits(F.regexp_replace(mention, f"^{COUNTRY}", "")))))
        .when(kind == "iban", F.array(one(kind, F.regexp_replace(mention, " ", ""))))
        .when(kind == "ip", F.array(one(kind, mention)))
        .otherwise(F.array(one(kind, digits(mention))))
    )


def hashed(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """256 hexadecimal digits drawn by a key."""
    part = lambda k: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(k)), kind, entity, attempt.cast("string")), 256)
    return F.concat(*[part(k) for k in range(4)])


def number(stream: Column, at: Column, modulus: int) -> Column:
    """A number below ``modulus`` from three digits of the stream, read cyclically."""
    return F.pmod(F.conv(F.substring(stream, F.pmod(at * 3, F.lit(250)) + 1, F.lit(3)), 16, 10).cast("int"), F.lit(modulus))


def poured(stream: Column, form: Column) -> Column:
    """Letters and digits of the stream in the places of those of ``form``."""

    def one(c: Column, i: Column) -> Column:
        letter = F.lit(None).cast("string")
        for script, letters in LETTERS.items():
            pick = F.substring(F.lit(letters), number(stream, i, len(letters)) + 1, F.lit(1))
            letter = F.when(script_of(c) == script, pick).otherwise(letter)
        cased = F.when(F.upper(c) == c, F.upper(letter)).otherwise(letter)
        return F.when(c.rlike("[0-9]"), number(stream, i, 10).cast("string")).when(c.rlike(r"\p{L}"), cased).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), one), "")


def luhn_sum(number_: Column) -> Column:
    """Check sum of a digit string, the last digit at weight one."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(i, F.lit(2)) == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.reverse(F.split(number_, "")), weigh), F.lit(0), lambda a, b: a + b)


def name_of_domain(entity: Column) -> Column:
    """A domain without its last label and the dot before it."""
    return F.regexp_replace(entity, "\\.[^.]*$", "")


def draw(key: str, attempt: Column) -> Column:
    """The candidate surrogate of (kind, entity) at an attempt."""
    kind, entity = F.col("kind"), F.col("entity")
    more = F.repeat(F.lit("0"), F.greatest(attempt - LONGER + 1, F.lit(0)))

    def made(stream: Column) -> Column:
        rest = lambda keep: F.concat(F.substring(entity, 1, keep), poured(stream, F.substring(entity, keep + 1, 1000)))
        body = F.concat(F.substring(entity, 1, 1), poured(stream, F.expr("substring(entity, 2, length(entity) - 2)")))
        check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        valid = F.pmod(luhn_sum(entity), F.lit(10)) == 0
        card = F.concat(body, F.when(valid, check).otherwise(F.pmod(check + 1 + number(stream, F.lit(40), 9), F.lit(10))).cast("string"))
        octet = lambda i: (number(stream, F.lit(i), 254) + 1).cast("string")
        private = F.when(entity.rlike(r"^10\."), F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))).when(entity.rlike(r"^192\.168\."), F.concat_ws(".", F.lit("192.168"), octet(2), octet(3)))
        if_full = F.when((attempt >= WIDER) & entity.rlike(r"^192\.168\."), F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3)))
        ip = F.coalesce(if_full, private, F.concat_ws(".", (number(stream, F.lit(0), 89) + 11).cast("string"), octet(1), octet(2), octet(3)))
        domain = F.concat(poured(stream, F.concat(name_of_domain(entity), more)), F.lit("."), F.substring_index(entity, ".", -1))
        mailbox = poured(stream, F.concat(F.substring_index(entity, "@", 1), more))
        phone = poured(stream, F.concat(entity, more))
        name = F.lit(None).cast("string")
        for script, syllables in SYLLABLES.items():
            listed = F.array(*[F.lit(s) for s in syllables.split()])
            body_of = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + attempt), lambda i: F.get(listed, number(stream, i, len(syllables.split())))), "")
            end = F.when(kind == "first-f", ENDINGS[script]["f"]).when(kind == "first-m", ENDINGS[script]["m"]).when(kind == "first-u", ENDINGS[script]["u"]).otherwise(ENDINGS[script]["last"])
            name = F.when(script_of(entity) == script, F.concat(body_of, end)).otherwise(name)
        return (
            F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "domain", domain).when(kind == "mailbox", mailbox)
            .when(kind == "iban", rest(2)).when(kind == "phone", phone).when(kind == "ssn", poured(stream, entity))
            .otherwise(name)
        )

    return let(hashed(key, kind, entity, attempt), made)


def form_of(kind: Column, entity: Column) -> Column:
    """The form that the surrogates by rank of an entity have: fixed lead, places for letters and digits, fixed tail, check digit (none, valid, invalid)."""
    shape = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), r"\p{IsCyrillic}", "а"), r"\p{IsGreek}", "α"), r"\p{Lu}(?<=[^\p{IsCyrillic}\p{IsGreek}])", "A"), r"[\p{L}&&[^Aаα]]", "a")
    form = lambda lead, places, tail="", check="": F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in (("lead", lead), ("places", places), ("tail", tail), ("check", check))])
    more = "0" * 12
    named = F.when(kind == "first-f", "f").when(kind == "first-m", "m").when(kind == "first-u", "u").otherwise("last")
    return (
        F.when(kind == "mailbox", form("", F.concat(shape(F.substring_index(entity, "@", 1)), F.lit(more))))
        .when(kind == "domain", form("", F.concat(shape(name_of_domain(entity)), F.lit(more)), F.concat(F.lit("."), F.substring_index(entity, ".", -1))))
        .when(kind == "phone", form("", F.concat(shape(entity), F.lit(more))))
        .when(kind == "ip", form(F.when(entity.rlike(r"^(10|192\.168)\."), "10.").otherwise(""), F.when(entity.rlike(r"^(10|192\.168)\."), "...").otherwise("....")))
        .when(kind == "iban", form(F.substring(entity, 1, 2), shape(F.substring(entity, 3, 1000))))
        .when(kind == "card", form(F.substring(entity, 1, 1), shape(F.expr("substring(entity, 2, length(entity) - 2)")), "", F.when(F.pmod(luhn_sum(entity), F.lit(10)) == 0, "valid").otherwise("invalid")))
        .when(kind == "ssn", form("", shape(entity)))
        .otherwise(form(script_of(entity), "," * 16, named))
    )


def radix(place: Column, i: Column) -> Column:
    """How many values a place of a form has; 1: none but its own."""
    return F.when(place == "0", 10).when(place.isin("A", "a", "а", "α"), 24).when((place == ".") & F.col("kind").eqNullSafe("ip"), F.when((i == 0) & (F.col("form.lead") == ""), 89).otherwise(254)).when((place == ",") & F.col("kind").rlike("^(first|last)"), 20).otherwise(1).cast("bigint")


def valued(n: Column) -> Column:
    """The ``n``-th value of the column ``form`` of the column ``kind``: the number in mixed radix, the last place the lowest."""
    form = F.col("form")
    places = F.split(form["places"], "")
    last = F.size(places) - 1

    def step(acc: Column, at: Column) -> Column:
        place, i = F.get(places, last - at), last - at
        size = radix(place, i)
        digit = F.pmod(acc["left"], size).cast("int")
        letter = lambda script: F.substring(F.lit(LETTERS[script]), digit + 1, F.lit(1))
        syllable = F.lit(None).cast("string")
        for script, listed in SYLLABLES.items():
            syllable = F.when(form["lead"] == script, F.get(F.array(*[F.lit(x) for x in listed.split()]), digit)).otherwise(syllable)
        shown = (
            F.when(size == 1, place).when(place == "0", digit.cast("string")).when(place == "A", F.upper(letter("latin"))).when(place == "a", letter("latin")).when(place == "а", letter("cyrillic")).when(place == "α", letter("greek"))
            .when(place == ".", F.concat((digit + F.when(size == 89, 11).otherwise(1)).cast("string"), F.when(i < last, ".").otherwise(""))).otherwise(syllable)
        )
        return F.struct(F.floor(acc["left"] / size).cast("bigint").alias("left"), F.concat(shown, acc["out"]).alias("out"))

    out = F.aggregate(F.sequence(F.lit(0), last), F.struct(n.cast("bigint").alias("left"), F.lit("").alias("out")), step)["out"]

    def whole(body: Column) -> Column:
        led = F.concat(form["lead"], body)
        check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(led, F.lit("0"))), F.lit(10)), F.lit(10))
        end = F.lit(None).cast("string")
        for script, ends in ENDINGS.items():
            for which, letters in ends.items():
                end = F.when((form["lead"] == script) & (form["tail"] == which), letters).otherwise(end)
        return (
            F.when(F.col("kind") == "card", F.concat(led, F.pmod(check + F.when(form["check"] == "valid", 0).otherwise(1), F.lit(10)).cast("string")))
            .when(F.col("kind").rlike("^(first|last)"), F.concat(body, end)).otherwise(F.concat(led, form["tail"]))
        )

    return let(out, whole)


def by_rank(left: DataFrame, taken: DataFrame) -> DataFrame:
    """(kind, entity, scope, surrogate) for ``left`` (kind, entity, scope): the k-th entity of a form gets its k-th value not in ``taken`` (kind, scope, surrogate).

    As many values are listed as there are entities and taken values of the
    kind and scope, so enough are free unless the form is exhausted.
    """
    group = ["kind", "scope", "form"]
    w = Window.partitionBy(*group)
    ranked = left.withColumn("form", form_of(F.col("kind"), F.col("entity"))).withColumn("k", F.row_number().over(w.orderBy("entity")))
    used = taken.groupBy("kind", "scope").agg(F.count("*").alias("used"))
    groups = ranked.groupBy(*group).agg(F.count("*").alias("n")).join(used, ["kind", "scope"], "left")
    size = F.aggregate(F.split("form.places", ""), F.struct(F.lit(1.0).alias("of"), F.lit(0).alias("i")), lambda a, c: F.struct((a["of"] * radix(c, a["i"])).alias("of"), (a["i"] + 1).alias("i")))["of"]
    listed = groups.withColumn("last", F.least(F.col("n") + F.coalesce("used", F.lit(0)), F.when(size < 1e18, size.cast("bigint")))).select(*group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last") - 1)).alias("at"))
    free = listed.select(*group, "at", valued(F.col("at")).alias("surrogate")).join(taken.select("kind", "scope", "surrogate"), ["kind", "scope", "surrogate"], "left_anti")
    # Two forms of a kind may share a value (a lead or a padded length): the least form has it.
    free = free.groupBy("kind", "scope", "surrogate").agg(F.min_by(F.struct("form", "at"), F.struct("form", "at")).alias("x")).select("kind", "scope", F.col("x.form").alias("form"), F.col("x.at").alias("at"), "surrogate")
    return ranked.join(free.withColumn("k", F.row_number().over(w.orderBy("at"))), [*group, "k"]).select("kind", "entity", "scope", "surrogate")


def surrogates(found: DataFrame, key: str, *, attempts: int = 12) -> DataFrame:
    """(kind, entity, surrogate) for the distinct entities of ``found`` (kind, entity).

    Each round draws for what is left; of equal candidates the least entity
    wins, and candidates already taken or found as entities lose. After the
    rounds values are given by rank.
    """
    # A mailbox is told apart by its domain too; domains have surrogates of their own.
    scope = F.when(F.col("kind") == "mailbox", F.substring_index("entity", "@", -1)).otherwise("").alias("scope")
    left = checkpoint(found.select("kind", "entity", scope).distinct())
    originals = left.select("kind", "scope", F.when(F.col("kind") == "mailbox", F.substring_index("entity", "@", 1)).otherwise(F.col("entity")).alias("surrogate")).distinct()
    value = ["kind", "scope", "surrogate"]
    done = left.select("kind", "entity", "scope", F.lit(None).cast("string").alias("surrogate")).limit(0)
    for attempt in range(attempts):
        drawn = left.withColumn("surrogate", draw(key, F.lit(attempt)))
        free = drawn.join(originals, value, "left_anti")
        if attempt:
            free = free.join(done.select(*value), value, "left_anti")
        won = free.groupBy(*value).agg(F.min("entity").alias("entity")).select("kind", "entity", "scope", "surrogate")
        done = checkpoint(done.unionByName(won) if attempt else won)
        left = checkpoint(left.join(done.select("kind", "entity"), ["kind", "entity"], "left_anti"))
        if left.isEmpty():
            return done.drop("scope")
    done = checkpoint(done.unionByName(by_rank(left, originals.unionByName(done.select(*value)))))
    left = left.join(done.select("kind", "entity"), ["kind", "entity"], "left_anti")
    if not left.isEmpty():
        raise RuntimeError("a form has fewer free values than entities")
    return done.drop("scope")


def in_form(mention: Column, kind: Column, made: Column) -> Column:
    """A mention's replacement in the form of the mention. ``made``: surrogates in order."""

    def fill(shape: Column, values: Column) -> Column:
        """The digits and letters of a value, one by one, in the places of the shape's; what is longer follows."""
        chars = F.split(shape, "")
        spot = r"[0-9A-Za-z]"
        index = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
        return F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(spot), F.substring(values, index(i), F.lit(1))).otherwise(c)), ""), F.substring(values, F.length(F.regexp_replace(shape, "[^0-9A-Za-z]", "")) + 1, F.lit(1000)))

    def in_case(part: Column, value: Column) -> Column:
        """Capitals where the part has them; what is longer is as the last letter."""
        big = lambda i: F.substring(part, F.least(i + 1, F.length(part)), F.lit(1))
        return F.when(F.lower(part) == part, value).otherwise(F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(F.lower(big(i)) != big(i), F.upper(c)).otherwise(c)), ""))

    def cased(part: Column, value: Column) -> Column:
        return F.when((F.upper(part) == part) & (F.length(part) > 1), F.upper(value)).otherwise(F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 1000)))

    shown = F.transform(parts_of(mention), lambda p, i: F.concat(cased(p, F.get(made, i)), F.regexp_extract(p, "'[sS]?$", 0)))
    named = F.concat(F.regexp_extract(mention, f"^{TITLED}+", 0), F.array_join(shown, " "))
    mail = F.concat_ws("@", in_case(F.substring_index(mention, "@", 1), F.get(made, 0)), in_case(F.substring_index(mention, "@", -1), F.get(made, 1)))
    country = F.when(kind == "phone", F.regexp_extract(mention, f"^{COUNTRY}", 0)).otherwise(F.lit(""))
    number_ = F.concat(country, fill(F.when(kind == "phone", F.regexp_replace(mention, f"^{COUNTRY}", "")).otherwise(mention), F.get(made, 0)))
    return F.when(kind == "name", named).when(kind == "email", mail).when(kind == "ip", F.get(made, 0)).otherwise(number_)


def replace_entities(docs: DataFrame, *, key: str, salts: int = 16) -> DataFrame:
    """doc_id, text with surrogates, n_entities and the count of each kind, of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    has = F.coalesce(may_have(F.col("text")) & F.col("text").rlike(ANY), F.lit(False))
    titled = docs.where(has).select("doc_id", "text", once(F.regexp_extract_all("text", F.lit(ANY), F.lit(1))).alias("m0"))
    titled = titled.select("doc_id", "text", "m0", once(roles_of(F.col("m0"))).alias("roles"))
    hit = titled.select("doc_id", "text", "m0", "roles", once(pattern_of(F.col("roles"))).alias("any"))
    again = F.size("roles") > 0
    # Texts with mentions are matched once; what follows reads the pieces.
    hit = written(hit.select("doc_id", F.monotonically_increasing_id().alias("row"), "roles", "m0", F.when(again, F.regexp_extract_all("text", F.col("any"), F.lit(1))).otherwise(F.col("m0")).alias("m"), F.when(again, F.split("text", F.col("any"), -1)).otherwise(F.split("text", ANY, -1)).alias("gaps")), "mentions")
    # One row for each piece: a gap and the mention that ends it; the last gap has none.
    piece = hit.select("doc_id", "row", F.posexplode("gaps").alias("pos", "gap"), "m", "roles").select("doc_id", "row", "pos", "gap", "roles", F.get("m", F.col("pos")).alias("mention"))
    piece = piece.withColumn("kind", F.when(F.col("mention").isNotNull(), kind_of(F.col("mention"))))
    # Further mentions of names bring no entities of their own.
    listed = hit.select(F.explode(F.array_distinct("m0")).alias("mention"), "roles")
    found = listed.select(F.explode(entities(F.col("mention"), kind_of(F.col("mention")), F.col("roles"))).alias("e")).select("e.kind", "e.entity")
    table = surrogates(found, key)
    salted = table.select(F.col("kind").alias("__kind"), F.col("entity").alias("__entity"), "surrogate").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    parts = piece.where(F.col("mention").isNotNull()).select("doc_id", "row", "pos", "gap", "mention", "kind", F.posexplode(entities(F.col("mention"), F.col("kind"), F.col("roles"))).alias("part", "e"))
    parts = parts.select("doc_id", "row", "pos", F.when(F.col("part") == 0, F.col("gap")).alias("gap"), "mention", "kind", "part", F.col("e.kind").alias("__kind"), F.col("e.entity").alias("__entity"), F.pmod(F.xxhash64("row", "pos"), F.lit(salts)).cast("int").alias("__salt"))
    met = parts.join(salted, ["__kind", "__entity", "__salt"]).select("doc_id", "row", "pos", "gap", "mention", "kind", "part", "surrogate")
    tails = piece.where(F.col("mention").isNull()).select("doc_id", "row", "pos", "gap", "mention", "kind", F.lit(0).alias("part"), F.lit(None).cast("string").alias("surrogate"))
    grouped = met.unionByName(tails).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "gap", "mention", "kind", "surrogate"))).alias("p"))
    heads = F.filter("p", lambda x: x["part"] == 0)

    def shown(x: Column) -> Column:
        own = F.transform(F.filter("p", lambda y: y["pos"] == x["pos"]), lambda y: y["surrogate"])
        return F.concat(x["gap"], F.when(x["mention"].isNotNull(), let(own, lambda made: in_form(x["mention"], x["kind"], made))).otherwise(F.lit("")))

    count = lambda kinds, k: F.size(F.filter(kinds, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    built = grouped.select("doc_id", heads.alias("h"), "p").select(
        "doc_id", F.array_join(F.transform("h", shown), "").alias("text"), F.size(F.filter("h", lambda x: x["mention"].isNotNull())).cast("long").alias("n_entities"), *[count("h", k) for k in KINDS]
    )
    zero = F.lit(0).cast("long")
    clean = docs.where(~has).select("doc_id", "text", zero.alias("n_entities"), *[zero.alias(f"n_{k}") for k in KINDS])
    return clean.unionByName(built)
