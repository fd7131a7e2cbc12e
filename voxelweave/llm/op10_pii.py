"""Personal data replaced by surrogates.

Detected entities get a replacement that depends on a key and the entity alone,
so that the same entity has the same surrogate wherever it occurs, and that
keeps type and format: digits stay digits, letters stay letters of their case,
separators stay, card numbers and IBANs keep valid check digits, names keep
gender (if known), script and hyphens. Digit strings are permuted by a Feistel
network, which maps different numbers to different ones.

Persons are found by what stands around a name: a title, a field ("Name:"), a
phrase ("my name is"), a close or an address of a letter, an e-mail address of
the same text that spells the name, or a common given name before it. Further
mentions of their names in the text, whole words, are theirs too. Two capitalised
words without such a sign are left alone, as most are no persons.

Distinctness is checked over the corpus: the distinct entities with their
surrogates form a distributed table; where two entities share a surrogate, or a
surrogate is itself an entity of the corpus, all but the smallest entity draw
again with the next attempt number (made-up names grow by a syllable then), until
none is left; entities that still collide after the last round are an error.
Common given names are permuted among themselves by a keyed cycle: they stay
distinct and none stays itself, but a surrogate may be another person's name.
Attempts other than 0 reach the rewriting by broadcast if they are few (counted),
else by a join.

Defined results: null text stays null with no entities; clean texts come back
unchanged, byte for byte; null or repeated doc_ids are rows like others; columns
named n_entities or entities are replaced; whole texts are read.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import arrow_map, Scratch

#: Session setting of the key; whoever knows the key can link surrogates to guesses.
KEY_SETTING = "spark.voxelweave.surrogates.key"
#: The key of the registered query and the tests where the setting is absent.
PUBLIC_KEY = "voxelweave-surrogates"
ROUNDS = 8
#: From this attempt on, forms with few variants give way to longer or plainer ones.
LOOSE = 5
#: More redrawn entities than that are joined, not broadcast.
FEW = 200_000

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Amelia Barbara Caroline Charlotte Christine Claire Elizabeth Emily Emma Hannah Helen Isabella Jennifer Jessica Julia Karen Katherine Laura Linda Margaret Maria Mary Nancy Olivia Patricia Rachel Rebecca Sarah Sophie Susan Victoria".split(),
    ("latin", "m"): "Alexander Andrew Anthony Benjamin Charles Christopher Daniel David Edward Frank George Henry Jack James John Joseph Kevin Lucas Mark Matthew Michael Nicholas Oliver Patrick Paul Peter Richard Robert Samuel Steven Thomas William".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия Дарья Полина".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел Олег Владимир Максим Роман".split(),
}
# Sounds of made-up names by script: first letters, second letters,
# endings of surnames, and endings of given names by gender (u: unknown).
SYLLABLES = {
    "latin": ("bcdfghjklmnprstvw", "aeiou", ("son", "ford", "well", "field", "man", "wood", "by", "ler"), {"f": ("a", "ia", "ina", "elle"), "m": ("o", "an", "us", "ard"), "u": ("is", "en", "y", "el")}),
    "cyrillic": ("бвгдзклмнпрстф", "аеиоу", ("в", "нов", "лов", "ров"), {"f": ("а", "ия", "ина"), "m": ("ан", "ий", "ор"), "u": ("и", "ели")}),
    "greek": ("βγδκλμνπρστφ", "αειου", ("δης", "πουλος", "κης"), {"f": ("α", "ια"), "m": ("ος", "ης"), "u": ("ι", "ω")}),
}
# Titles and the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f"}
# Fields, phrases and closes that a full name follows.
FIELDS = ("Name", "name", "Full Name", "Author", "author", "Contact", "contact", "Signed", "Attn", "Kontakt", "Ansprechpartner", "Nom", "Auteur", "Nombre", "Autor", "Contacto", "Имя", "ФИО", "Автор")
PHRASES = ("my name is", "My name is", "I am", "I'm", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "mon nom est", "Mon nom est", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "меня зовут", "Меня зовут", "written by", "Written by", "signed by", "Signed by", "Dear", "Sincerely,", "Regards,", "regards,", "Yours,", "Grüßen", "Cordialement,", "Atentamente,", "Saludos,", "уважением,")

_GENDER = {n.lower(): g for (_, g), names in GIVEN.items() for n in names}


def _letters(case: str) -> str:
    """All letters of one case of the Latin, Greek and Cyrillic blocks."""
    return "".join(c for c in map(chr, range(0x41, 0x530)) if getattr(c, f"is{case}")())


_UP, _LOW = _letters("upper"), _letters("lower")
_NAME = rf"(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:-[{_UP}]?[{_LOW}]+)*"
_BETWEEN = r"(?:(?:von|van|der|den|de|del|la|di|da|du|le) )*"
_FULL = rf"({_NAME})(?: [{_UP}]\.)? {_BETWEEN}({_NAME})(?![\w])"
_PHONE = (
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|(?<![.-])0\d{1,4}[ /-]\d{3,4}[ -]\d{2,4}(?:[ -]\d{2,4})?|(?<![.-])0\d(?:[ .]\d{2}){4}|(?<![.-])0\d{2,4}/\d{5,8})(?!\w|\.\d)"
)
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>\bAKIA[A-Z0-9]{16}\b|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*)(?P<value>\"[^\"\s]{8,}\"|'[^'\s]{8,}'|(?=[^\s\"']*\d)[^\s\"',;]{8,}))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<card>(?<!\w)(?:\d[ -]?){12,18}\d(?!\w|\.\d))"
    rf"|(?P<phone>{_PHONE})"
)
_PHONES = re.compile(_PHONE)
#: What every match of the pattern has: a digit of any script, '@', AKIA or the begin of a quoted value.
_ANY = re.compile(r"""[\d@]|AKIA|[=:]\s*["']""")
_TITLED = re.compile(rf"\b({'|'.join(TITLES)})(\.?)( )(?:(?:Dr|Prof)\.? )*{_BETWEEN}({_NAME})(?:( ){_BETWEEN}({_NAME}))?")
_CUED = re.compile(rf"(?<!\w)(?:(?:{'|'.join(FIELDS)}) ?[:=]|{'|'.join(map(re.escape, PHRASES))})\s+{_FULL}")
_PAIR = re.compile(rf"({_NAME})(?: [{_UP}]\.)? {_BETWEEN}({_NAME})(?!\w)")


def _signs():
    """One automaton over what a person may be found by: titles, fields,
    phrases, common given names."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for kind, words in (("title", TITLES), ("cue", (*FIELDS, *PHRASES)), ("given", (n for names in GIVEN.values() for n in names))):
        for w in words:
            auto.add_word(w, {kind, *auto.get(w, ())})
    auto.make_automaton()
    return auto


_SIGNS = _signs()


def _luhn(digits: str) -> int:
    """What the last digit must be."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Surrogates:
    """Keyed replacements: ``attempt`` is 0 unless a collision was found."""

    def __init__(self, key: str):
        self.key = key.encode()
        self.following: dict[tuple[str, str], dict[str, str]] = {}

    def _bits(self, *what: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\0".join(map(str, what)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")

    def digits(self, kind: str, s: str, attempt: int) -> str:
        """A keyed permutation of the digit strings of this length."""
        if len(s) == 1:
            return str((int(s) + 1 + self._bits(kind, "one", attempt) % 9) % 10)
        h = len(s) // 2
        a, b = s[:h], s[h:]
        for r in range(ROUNDS):
            mod = 10 ** len(a)
            a, b = b, str((int(a) + self._bits(kind, attempt, r, len(s), b)) % mod).zfill(len(a))
        return a + b

    def letters(self, kind: str, s: str, attempt: int) -> str:
        """Letters and digits by a keyed stream that the whole string seeds."""
        stream, out = self._bits(kind, s.lower() if kind == "email" else s, attempt), []
        for i, c in enumerate(s):
            if i and i % 40 == 0:
                stream = self._bits(kind, s.lower() if kind == "email" else s, attempt, i)
            if "a" <= c <= "z" or "A" <= c <= "Z":
                base = 97 if c >= "a" else 65
                out.append(chr(base + stream % 26))
                stream //= 26
            elif c.isdigit():
                out.append(str(stream % 10))
                stream //= 10
            else:
                out.append(c)
        return "".join(out)

    def __call__(self, kind: str, canon: str, attempt: int = 0) -> str:
        if kind == "email":
            local, _, domain = canon.partition("@")
            n = self._bits("email", canon, attempt)
            host = self.letters("host", domain.split(".")[0], 0)
            tail = ("example.com", "example.org", "example.net")[self._bits("host", domain) % 3]
            more = n % 10**9 if attempt >= LOOSE else n % 100 if len(local) < 6 else ""
            return f"{self.letters('email', local + '@' + domain, attempt)[: len(local)]}{more}@{host}.{tail}"
        if kind == "card":
            if _luhn(canon[:-1]) == int(canon[-1]):
                body = canon[0] + self.digits("card", canon[1:-1], attempt)
                return body + str(_luhn(body))
            return self.digits("number", canon, attempt)
        if kind == "phone":
            return self.digits("phone", canon, attempt)
        if kind == "ssn":
            return self.digits("ssn", canon, attempt)
        if kind == "ip":
            a, b = (int(x) for x in canon.split(".")[:2]), (int(x) for x in canon.split(".")[2:])
            a, b = next(a) * 256 + next(a), next(b) * 256 + next(b)
            for r in range(ROUNDS):
                a, b = b, (a + self._bits("ip", attempt, r, b)) % 65536
            return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
        if kind == "iban":
            body = canon[:2] + "00" + self.letters("iban", canon[4:], attempt)
            rest = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
            return body[:2] + f"{rest:02d}" + body[4:]
        if kind == "secret":
            if re.fullmatch(r"[0-9a-fA-F]+", canon):
                out = f"{self._bits('secret', canon, attempt):064x}" + f"{self._bits('secret', canon, attempt, 1):064x}"
                while len(out) < len(canon):
                    out += f"{self._bits('secret', canon, attempt, len(out)):064x}"
                out = out[: len(canon)]
                return out.upper() if canon.upper() == canon else out
            head = 4 if canon.startswith("AKIA") else 0
            out = canon[:head] + self.letters("secret", canon[head:], attempt)
            if out == canon or attempt >= LOOSE:  # signs and other scripts, which letters() leaves as they are
                out = canon[:head] + self.letters("secret", "".join(c if c.isascii() and c.isalnum() else chr(97 + self._bits("sign", canon, attempt, i) % 26) for i, c in enumerate(canon[head:])), attempt)
            return out
        script, part, gender = kind.split("-")[1:]
        if part == "p":
            if (script, gender) not in self.following:
                # a keyed cycle: names of the pool stay distinct and none stays itself
                cycle = sorted(GIVEN[script, gender], key=lambda n: self._bits(kind, "cycle", n))
                self.following[script, gender] = {a.lower(): b for a, b in zip(cycle, cycle[1:] + cycle[:1])}
            return self.following[script, gender][canon]
        return "-".join(self._made_up(script, part, gender, canon, attempt, i) for i in range(canon.count("-") + 1))

    def _made_up(self, script: str, part: str, gender: str, canon: str, attempt: int, nth: int) -> str:
        """A made-up name; the space grows with each attempt."""
        first, second, endings, given = SYLLABLES[script]
        again = 0
        while True:
            n, out = self._bits("name", script, part, gender, canon, attempt, nth, again), ""
            for _ in range((3 if part == "s" else 2) + attempt):
                out += first[n % len(first)] + second[n // 32 % len(second)]
                n //= 1024
            ends = endings if part == "s" else given[gender]
            out += ends[n % len(ends)]
            if out not in _GENDER and out != canon:
                return out.capitalize()
            again += 1


def _script(name: str) -> str:
    c = next((c for c in name if c.isalpha()), "a")
    return "cyrillic" if c >= "\u0400" else "greek" if "\u0370" <= c < "\u0400" else "latin"


def _given(name: str, gender: str) -> tuple[str, str]:
    """Kind and canonical form of a given name."""
    low = name.lower()
    if low in _GENDER:
        return f"name-{_script(name)}-p-{_GENDER[low]}", low
    return f"name-{_script(name)}-g-{gender or 'u'}", low


def _surname(name: str) -> tuple[str, str]:
    return f"name-{_script(name)}-s-", name.lower()


def _numbers(text: str) -> list[tuple[int, int, str, str]]:
    """Entities that their own form tells: addresses, numbers, secrets."""
    out: list[tuple[int, int, str, str]] = []
    at = 0
    while m := _PATTERN.search(text, at):
        kind, s = m.lastgroup, m[0]
        a, b = m.span()
        at = b
        if m["secret"]:
            kind = "secret"
            if m["value"]:
                a, b = m.span("value")
                if text[a] in "\"'":
                    a, b = a + 1, b - 1
            canon = text[a:b]
        elif m["email"]:
            kind, canon = "email", s.lower()
        elif m["iban"]:
            kind, canon = "iban", s.replace(" ", "")
            if not _iban_ok(s):
                at = a + 1  # what lies inside may be another kind
                continue
        elif m["ip"]:
            kind, canon = "ip", s
        else:
            canon = "".join(str(int(c)) for c in s if c.isdigit())
            if kind == "card" and _luhn(canon[:-1]) != int(canon[-1]):
                phone = _PHONES.match(text, a)
                if not phone:
                    at = a + 1
                    continue
                kind, b = "phone", phone.end()
                canon, at = "".join(str(int(c)) for c in phone[0] if c.isdigit()), b
            if kind == "phone" and not 8 <= len(canon) <= 15:
                at = a + 1
                continue
        out.append((a, b, kind, canon))
    return out


def _persons(text: str, locals_: list[str]) -> dict[str, tuple[str, str]]:
    """Names as they stand in the text -> kind and canonical form."""
    found: dict[str, tuple[str, str]] = {}

    def add(given: str | None, surname: str, gender: str = "") -> None:
        if given:
            found.setdefault(given, _given(given, gender))
        found.setdefault(surname, _surname(surname))

    signs = set().union(*(k for _, k in _SIGNS.iter(text)))
    if "title" in signs:
        for m in _TITLED.finditer(text):
            if m[6] is None:
                add(None, m[4], TITLES[m[1]])
            else:
                add(m[4], m[6], TITLES[m[1]])
    if "cue" in signs:
        for m in _CUED.finditer(text):
            if m[1] not in TITLES:
                add(m[1], m[2])
    at = 0 if "given" in signs or locals_ else len(text)
    while m := _PAIR.search(text, at):
        at = m.end(1)
        low, last = m[1].lower(), re.sub("['’]", "", m[2].lower())
        if low in _GENDER and low != last and last not in _GENDER:
            add(m[1], m[2])
        elif locals_ and m[1] not in TITLES:
            spelled = {low + x + last for x in ("", ".", "_", "-")} | {last + x + low for x in (".", "_", "-")} | {low[0] + last, f"{low[0]}.{last}"}
            if any(x in spelled for x in locals_):
                add(m[1], m[2])
    return found


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(from, to, kind, canonical form) of the entities, in order."""
    out = _numbers(text) if _ANY.search(text) else []
    persons = _persons(text, [re.sub(r"[\d.]+$", "", c.partition("@")[0]) for _, _, k, c in out if k == "email"])
    if persons:
        forms = {f: v for n, v in persons.items() for f in (n, n.upper())}
        mentions = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(forms, key=lambda f: (-len(f), f))))})(?![\w-])")
        taken = [(a, b) for a, b, _, _ in out]
        ends = [b for _, b in taken]
        for m in mentions.finditer(text):
            i = bisect.bisect_right(ends, m.start())
            if i == len(taken) or taken[i][0] >= m.end():
                out.append((*m.span(), *forms[m[0]]))
        out.sort()
    return out


def _like(original: str, surrogate: str) -> str:
    """The surrogate's digits in the places and the script of the original's."""
    it = iter(surrogate)
    return "".join(chr(ord(c) - int(c) + int(next(it))) if c.isdigit() else c for c in original)


def _write(kind: str, original: str, surrogate: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return _like(original, surrogate)
    if kind == "iban":
        it = iter(surrogate)
        return "".join(c if c == " " else next(it) for c in original)
    if kind.startswith("name-") and original.isupper():
        return surrogate.upper()
    return surrogate


def _surrogate(make: Surrogates, kind: str, canon: str, attempt: int) -> str:
    if kind == "phone" and len(canon) == 11 and canon[0] == "1":  # the country code of North American numbers stays
        return "1" + make("phone", canon[1:], attempt)
    if kind == "phone" and canon[0] == "0":  # so does the zero of national ones
        return "0" + make("phone", canon[1:], attempt)
    return make(kind, canon, attempt)


def _table(key: str):
    """text -> kind, canon, surrogate of its entities."""

    def run(batches):
        import pyarrow as pa

        make = Surrogates(key)
        for batch in batches:
            rows = {(k, c) for t in batch.column(0).to_pylist() if t for _, _, k, c in find(t)}
            rows = [(k, c, _surrogate(make, k, c, 0)) for k, c in sorted(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "canon", "surrogate"])

    return run


def _redraw(key: str):
    def run(batches):
        import pyarrow as pa

        make = Surrogates(key)
        for batch in batches:
            k, c, n = (batch.column(i).to_pylist() for i in range(3))
            new = [_surrogate(make, *x) for x in zip(k, c, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(new, pa.string())], ["kind", "canon", "attempt", "surrogate"])

    return run


def entities(scratch: Scratch, docs: DataFrame, key: str, rounds: int = 20) -> DataFrame:
    """All distinct entities with the attempt whose surrogate no other entity
    has and that is no entity itself; an error if some still collide after the
    last round. Common given names are permuted, so they only have to differ."""
    table = docs.select("text").transform(arrow_map, _table(key), "kind string, canon string, surrogate string").distinct()
    table = scratch.keep(table.select("kind", "canon", F.lit(0).alias("attempt"), "surrogate"))
    pool = F.col("kind").rlike("^name-.*-p-")
    for attempt in range(rounds + 1):
        # one row per surrogate keeps it: the smallest entity
        first = Window.partitionBy("kind", "surrogate").orderBy("canon")
        lost = table.withColumn("_n", F.row_number().over(first)).where("_n > 1").select("kind", "canon")
        real = table.where(~pool).select("kind", F.lower("canon").alias("surrogate")).distinct()
        itself = table.where(~pool).withColumn("surrogate", F.lower("surrogate")).join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon")
        again = scratch.keep(lost.unionAll(itself).distinct())
        if again.isEmpty():
            break
        if attempt == rounds:
            raise ValueError(f"{again.count()} entities still collide after {rounds} rounds")
        redrawn = table.join(again, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        redrawn = redrawn.transform(arrow_map, _redraw(key), "kind string, canon string, attempt int, surrogate string")
        table = scratch.keep(table.join(again, ["kind", "canon"], "left_anti").unionAll(redrawn))
    return table


def _rewrite(key: str, known, keep: list[str], kinds: int):
    def run(batches):
        import pyarrow as pa

        make, memo = Surrogates(key), {}
        few = known.value if known is not None else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            maps = None if few is not None else batch.column(batch.schema.get_field_index("_attempts")).to_pylist()
            out, counts, names = [], [], []
            for i, t in enumerate(texts):
                hits = find(t) if t else []
                counts.append(len(hits))
                if not hits:
                    out.append(t)
                    names.append("")
                    continue
                attempts = few if maps is None else {(x["kind"], x["canon"]): x["attempt"] for x in maps[i] or []}
                parts, at, met = [], 0, {}
                for a, b, k, c in hits:
                    what = (k, c, attempts.get((k, c), 0))
                    if what not in memo:
                        if len(memo) > 20_000:
                            memo.clear()
                        memo[what] = _surrogate(make, *what)
                    parts += [t[at:a], _write(k, t[a:b], memo[what])]
                    at = b
                    name = k.split("-")[0]
                    met[name] = met.get(name, 0) + 1
                out.append("".join([*parts, t[at:]]))
                names.append(",".join(f"{k}:{n}" for k, n in sorted(met.items())))
            made = {"text": pa.array(out, pa.string()), "n_entities": pa.array(counts, pa.int32()), "entities": pa.array(names, pa.string())}
            columns = [made[c] if c in made else batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(columns, keep)

    return run


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, PUBLIC_KEY)


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with its text rewritten, and the columns n_entities, entities."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "op10")
    docs = docs.drop("n_entities", "entities")
    again = scratch.keep(entities(scratch, docs, key).where("attempt > 0").select("kind", "canon", "attempt"))
    kinds = dict(docs.dtypes)
    keep = [*docs.columns, "n_entities", "entities"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in docs.columns), "n_entities int, entities string"])
    if again.count() <= FEW:
        few = {(r[0], r[1]): r[2] for r in again.collect()}
        return docs.transform(arrow_map, _rewrite(key, spark.sparkContext.broadcast(few), keep, len(kinds)), schema)
    # too many to send everywhere: each text gets the attempts of its own entities
    def met(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(h, k, c) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, _, k, c in find(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string())] + [pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)], ["_text", "kind", "canon"])

    by_text = F.sha2("text", 256)
    have = docs.where("text is not null").select(by_text.alias("_text"), "text").transform(arrow_map, met, "_text string, kind string, canon string").distinct()
    own = have.join(again, ["kind", "canon"]).groupBy("_text").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("_attempts"))
    joined = docs.withColumn("_text", by_text).join(own, "_text", "left").drop("_text")
    return joined.transform(arrow_map, _rewrite(key, None, keep, len(kinds)), schema)


def op10_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark))
