"""Personal data replaced by surrogates that are keyed, consistent and of the same type.

find() reports mentions with a canonical form. Each distinct entity, kind and canonical form, gets one surrogate, derived from
a secret key, wherever it stands; a surrogate that is a real entity or another one's surrogate is derived anew, after
a few attempts from a wider space, so that distinct entities stay distinct, and each is certain to get one. A mention takes its surrogate in its own format: separators, case and lengths stay, card
numbers keep their issuer's digit and a valid check digit, addresses their network class, names their gender and script.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import forget, fresh, settle

#: Attempts in the space of an entity's own shape, and, for addresses, in the wider one of its class; later ones draw from spaces that grow.
NARROW, CLASS = 4, 8

_KEY = r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth(?:orization)?|credential)s?"
#: Kinds and patterns, in the order in which they claim a stretch of text. The group `v`, if any, is the entity.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])"),
    ("secret", rf"(?i:\b{_KEY})\s*(?:=|:|=>)\s*[\"']?(?P<v>(?=[+/_.~-]*[A-Za-z0-9])[A-Za-z0-9+/_.~-]{{6,}}=*)"),
    ("secret", r"(?<![A-Za-z0-9_])(?P<v>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,})"),
    ("secret", r"(?<![A-Za-z0-9])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])(?P<v>[a-fA-F0-9]{32,})(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ip6", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)(?P<v>[0-9A-Fa-f:]{2,38}(?:[0-9A-Fa-f]|::))(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z.])(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
]
#: Titles that announce a person's name, with the gender they tell.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "κύριος", "κύριο"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Señora", "Señorita", "Sra", "Signora", "г-жа", "госпожа", "κυρία"],
    "": ["Dr", "Prof", "Professor", "Councilmember", "Senator"],
}
#: First names by script and gender, which also tell the gender of a name after a neutral title.
FIRST = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix George Henry Ivan James Karl Louis Martin Noah Oscar Paul Robert Simon Thomas Victor Walter Bob John William Michael Richard Joseph Charles Daniel Matthew Anthony Steven Andrew Kenneth Joshua Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Benjamin Samuel Gregory Peter Hans Jürgen Klaus Stefan Wolfgang Jean Pierre Jacques François Juan José Carlos Luis Miguel Pedro Antonio".split(),
    ("latin", "f"): "Alice Bella Clara Diana Emma Fiona Grace Helen Irene Julia Karen Laura Maria Nora Olivia Paula Rosa Sarah Teresa Vera Wendy Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Anna Brenda Pamela Nicole Katherine Christine Ursula Monika Sabine Marie Sophie Isabelle Carmen Lucía Ana Isabel".split(),
    ("latin", ""): "Alex Robin Kim Jordan Taylor Sam Casey Jamie Morgan Riley".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Егор Иван Кирилл Лев Максим Николай Олег Павел".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Лидия Мария Нина Ольга Полина".split(),
    ("cyrillic", ""): "Женя Саша Валя Слава".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Ανδρέας Παύλος Πέτρος Σταύρος Μιχάλης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δήμητρα Ειρήνη Ιωάννα Βασιλική Χριστίνα".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha he ja ka ke la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we".split(),
    "cyrillic": "ба бе бо ва ве да де жа за ка ке ла ле ма ме мо на не но па ре ро са се та те то фа ха ча".split(),
    "greek": "βα βε βο γα γε δα δε ζα θα θε κα κε λα λε μα με να νε πα πε ρα ρε σα σε τα τε φα φε χα χε".split(),
    "armenian": "բա բե գա գե դա դե զա լա լե կա կե մա մե նա նե պա պե ռա սա սե տա տե".split(),
    "georgian": "ბა ბე გა გე და დე ვა ზა კა კე ლა ლე მა მე ნა ნე პა რა სა სე ტა ხა".split(),
    "hebrew": "בא גא דא הא וא זא חא טא יא כא לא מא נא סא פא קא רא שא תא".split(),
    "arabic": "با تا جا حا خا دا را زا سا شا طا عا فا قا كا لا ما نا ها وا يا".split(),
    "devanagari": "का के गा गे जा टा डा ता ते दा दे ना ने पा पे बा मा मे रा रे ला ले सा से".split(),
    "cjk": "安 白 陈 德 芳 国 海 华 杰 静 康 丽 林 明 宁 平 清 荣 思 田 文 晓 雪 云".split(),
    "hangul": "가 나 다 라 마 바 사 아 자 하 기 니 미 서 유 윤 은 정 준 지 진 현".split(),
    "hiragana": "あ い う え か き こ さ し た な の は ま み や ゆ ら り わ".split(),
    "katakana": "ア イ ウ エ カ キ コ サ シ タ ナ ノ ハ マ ミ ヤ ユ ラ リ ワ".split(),
}
#: Words that make a capitalised pair something else than a person.
_NOT_LAST = frozenset(
    "The A An And Or In On At Of Is Was Has Had Will Street Road Avenue Lane River Lake Park City County Island University College School Hospital Church "
    "Station Airport Period Day Week Month Year Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August "
    "September October November December Hall Bridge Mountain Valley Bay Prize Award Inc Ltd".split()
)
_GENDER = {t: g for g, ts in TITLES.items() for t in ts} | {}
_BY_FIRST = {n: g for (_, g), ns in FIRST.items() for n in ns}
_NAME = re.compile(
    r"(?<!\w)(?P<t>" + "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True)) + r")\.?[ \u00a0]+(?P<v>[^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z][^\W\d_]+){0,2})"
)
_WORD = re.compile(r"[^\W\d_]+")
_LAST = re.compile(r"[ \u00a0][^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z][^\W\d_]+)?")
#: What each of PATTERNS cannot do without; looked for first, once a text, since most texts have none of them.
_DIGIT, _COLON = "[0-9]", ":"
SIGNS = ["@", "[=:]", "AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ", _DIGIT, _DIGIT, _DIGIT, _DIGIT, _COLON, _DIGIT, _DIGIT, _DIGIT]
_COMPILED = [(k, re.compile(sign), re.compile(p)) for (k, p), sign in zip(PATTERNS, SIGNS, strict=True)]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_digits(country: str, body: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def canonical(kind: str, said: str) -> str:
    if kind == "email":
        return said.lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(said).compressed
    if kind in ("card", "ssn"):
        return _digits(said)
    if kind == "iban":
        return said.replace(" ", "")
    if kind == "phone":
        d = _digits(said)
        return d[1:] if len(d) == 11 and d[0] == "1" else d
    return said


def _is_ip6(said: str) -> bool:
    try:
        ipaddress.IPv6Address(said)
    except ValueError:
        return False
    return "::" not in said or bool(re.search("[0-9]", said))  # a::b is as likely a name in a programme


def _script(said: str) -> str:
    return unicodedata.name(said[0], "LATIN").split()[0].lower()


def _cut(said: str, more: frozenset[str] = frozenset()) -> str:
    """A capitalised run up to its first word that is in small letters, or in `more`."""
    for m in _WORD.finditer(said):
        if m[0][0].islower() and _script(m[0]) != "georgian" or m.start() and m[0] in more:
            return said[: m.start()].rstrip(" \u00a0-")
    return said


def _key(said: str) -> str:
    return said.replace("\u00a0", " ").casefold()


def _parts(key: str) -> list[str]:
    return re.split(r"[ \u00a0-]", key)


def _names(text: str, free) -> list[tuple[int, int, str, str]]:
    """Names behind titles, first names with a last name, and all further mentions of these, or of their first or last part.

    A part, also with a title that doesn't tell another gender, is a mention of the one full name in the text that has it.
    """
    told: list[tuple[int, int, str]] = []  # start, end, gender
    taken = bytearray(len(text))  # places in a name
    for m in _NAME.finditer(text):
        a = m.start("v")
        said = _cut(m["v"])
        if said and free(a, a + len(said)):
            parts = _parts(said)
            told.append((a, a + len(said), _GENDER[m["t"]] or (_BY_FIRST.get(parts[0], "") if len(parts) > 1 else "")))
            taken[a : a + len(said)] = b"\1" * len(said)
    if not _BY_FIRST.keys().isdisjoint(_WORD.findall(text)):
        held = {a for a, _, _ in told}
        for m in _WORD.finditer(text):
            rest = m[0] in _BY_FIRST and m.start() not in held and not re.match(r"\w", text[m.start() - 1 : m.start()]) and _LAST.match(text, m.end())
            if rest:
                a, said = m.start(), _cut(text[m.start() : rest.end()], _NOT_LAST)
                if len(said) > len(m[0]) and free(a, a + len(said)) and taken.find(1, a, a + len(said)) < 0:
                    told.append((a, a + len(said), _BY_FIRST[m[0]]))
                    taken[a : a + len(said)] = b"\1" * len(said)
    if not told:
        return []
    genders: dict[str, set[str]] = {}
    for a, b, g in told:
        genders.setdefault(_key(text[a:b]), set()).update({g} - {""})
    one = lambda key: next(iter(genders[key])) if len(genders[key]) == 1 else ""
    owners: dict[str, set[str]] = {}
    for key in genders:
        parts = key.split(" ")  # a hyphenated name is one part: Smith is not Smith-Jones
        for part in {parts[0], parts[-1]} if len(parts) > 1 else ():
            owners.setdefault(part, set()).add(key)

    def entity(said: str, gender: str = "") -> tuple[str, str]:
        key = _key(said)
        of = owners.get(key, set())
        if gender or key in genders:
            gender = gender or one(key)
            of = {o for o in of if not (gender and one(o) and gender != one(o))}
        key = next(iter(of)) if len(of) == 1 else key
        return f"name-{_script(said)}-{(one(key) if key in genders else gender) or 'n'}", key

    out = [(a, b, *entity(text[a:b], g)) for a, b, g in told]
    starts: dict[str, set[str]] = {}
    for a, b, _ in told:
        said = text[a:b]
        words = [m[0] for m in _WORD.finditer(said)]
        for form in {said, words[0], words[-1]}:
            starts.setdefault(_WORD.match(form)[0], set()).add(form)
    longest = {w: sorted(forms, key=len, reverse=True) for w, forms in starts.items()}
    for m in _WORD.finditer(text):
        for form in longest.get(m[0], ()):
            a, b = m.start(), m.start() + len(form)
            whole = text.startswith(form, a) and not re.match(r"\w", text[b : b + 1]) and not re.match(r"\w", text[a - 1 : a] if a else "")
            if whole and taken.find(1, a, b) < 0 and free(a, b):
                taken[a:b] = b"\1" * (b - a)
                out.append((a, b, *entity(form)))
                break
    return out


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of the mentions in a text, in order, without overlaps."""
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray()
    free = lambda a, b: taken.find(1, a, b) < 0
    told: dict[re.Pattern, bool] = {}
    for kind, sign, pattern in _COMPILED:
        if sign not in told:
            told[sign] = sign.search(text) is not None
        if not told[sign]:
            continue
        for m in pattern.finditer(text):
            a, b = m.span("v") if "v" in pattern.groupindex else m.span()
            if kind == "card" and not luhn(_digits(m[0])):
                continue
            if kind == "phone" and not 8 <= len(_digits(m[0])) <= 15:
                continue
            if kind == "iban" and not (n := canonical(kind, m[0]))[2:4] == iban_digits(n[:2], n[4:]):
                continue
            if kind == "ip6" and not _is_ip6(text[a:b]):
                continue
            if free(a, b):
                taken = taken or bytearray(len(text))
                taken[a:b] = b"\1" * (b - a)
                out.append((a, b, kind, canonical(kind, text[a:b])))
    return sorted(out + _names(text, free))


class _Stream:
    """Numbers that a key, an entity and the attempt determine."""

    def __init__(self, secret: bytes, *what: str):
        self.secret, self.what, self.block, self.pool = secret, "\x1f".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.secret, self.what + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def like(self, s: str, keep: str = "") -> str:
        """s with each letter and digit replaced by one of its class; hexadecimal strings stay such."""
        hexa = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))
        out = []
        for c in s:
            if c in keep:
                out.append(c)
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif "a" <= c <= "z":
                out.append(chr(97 + self.below(6 if hexa else 26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self.below(6 if hexa else 26)))
            else:
                out.append(c)
        return "".join(out)


def _letters(key: str) -> list[str]:
    """Letters of the script of a name's first letter, near it, for scripts without a table."""
    script, low = _script(key), ord(key[0]) // 128 * 128
    return [c for c in map(chr, range(low, low + 128)) if c.isalpha() and not c.isupper() and _script(c) == script] or ["x", "y"]


def surrogate(kind: str, key: str, attempt: int, secret: bytes) -> str:
    """The canonical form that stands for an entity. After NARROW attempts it gets longer with each, so no space stays full."""
    s = _Stream(secret, kind, key, str(attempt))
    more = "0" * (2 * max(0, attempt - NARROW + 1))
    if kind == "email":
        local, _, domain = key.rpartition("@")
        labels = domain.split(".")
        host = _Stream(secret, "domain", domain)  # the same for all addresses of a domain
        return f"{s.like(local + more)}@{'.'.join([*(host.like(x) for x in labels[:-1]), labels[-1]])}"
    if kind == "card":
        body = key[0] + s.like(key[1:-1] + more)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "ip":
        if attempt >= CLASS:  # all IPv4 forms of its class may be held: a local IPv6 address
            return "fd" + ":".join(f"{s.below(1 << 16):04x}" for _ in range(8))[2:]
        parts = key.split(".")
        keep = 1 if parts[0] in ("10", "127") else 2 if key.startswith("192.168.") or parts[0] == "172" and 16 <= int(parts[1]) <= 31 else 0
        if keep == 2 and more:  # the largest private network
            parts, keep = ["10"], 1
        top = lambda: str(next(x for x in iter(lambda: 1 + s.below(223), None) if x not in (10, 127, 172, 192)))
        return ".".join([*parts[:keep], *([top()] if not keep else []), *(str(s.below(256)) for _ in range(3 if not keep else 4 - keep))])
    if kind == "ip6":
        groups = ipaddress.IPv6Address(key).exploded.split(":")
        made = []
        for i, g in enumerate(groups):
            width = 4 if more else len(g.lstrip("0"))  # runs of zeros stay, so a short form stays short
            new = f"{s.below(16**width - 16 ** (width - 1)) + 16 ** (width - 1):04x}" if width else g
            if i == 0:  # the kind of network
                new = g if g[:3] in ("fe8", "fe9", "fea", "feb") else g[:2] + new[2:] if g[:2] in ("fc", "fd", "ff") else g[0] + new[1:] if width == 4 and g[0] != "0" else new
            made.append(new)
        return ipaddress.IPv6Address(":".join(made)).compressed
    if kind == "iban":
        body = s.like(key[4:] + more)
        return key[:2] + iban_digits(key[:2], body) + body
    if kind == "phone":
        return (str(2 + s.below(8)) if key[:1] > "1" or more else key[:1]) + s.like(key[1:] + more)
    if kind.startswith("name-"):
        _, script, gender = kind.split("-")
        pool = FIRST.get((script, gender if gender != "n" else "")) or FIRST.get((script, "m"), []) + FIRST.get((script, "f"), [])
        parts = re.split(r"([ -])", key)
        syl = _SYLLABLES.get(script) or _letters(key)
        made = []
        for i, part in enumerate(parts):
            if i % 2:
                made.append(part)
            elif i == 0 and len(parts) > 1 and pool:
                others = [n for n in pool if n.casefold() != part]
                made.append(others[s.below(len(others))])
            else:
                made.append("".join(syl[s.below(len(syl))] for _ in range(3 + s.below(2) + len(more) // 2)))
        return "".join(made).casefold()
    return s.like(key + more)


def render(kind: str, said: str, new: str, key: str | None = None) -> str:
    """A surrogate in the format of a mention; for a part of the name `key`, that part of it."""
    if kind in ("card", "ssn", "phone", "iban"):
        places = [i for i, c in enumerate(said) if c.isalnum()]
        out = list(said)
        longer = max(0, len(new) - len(places))  # characters beyond the mention's go before its first one
        for i, c in zip(places[len(places) - len(new) + longer :], [new[: longer + 1], *new[longer + 1 :]]):
            out[i] = c
        return "".join(out)
    if kind == "ip6":
        made = ipaddress.IPv6Address(new)
        if "::" not in said:
            groups = made.exploded.split(":")
            new = ":".join(groups if all(len(g) == 4 for g in said.split(":")) else [f"{int(g, 16):x}" for g in groups])
        return new.upper() if said.upper() == said != said.lower() else new
    if kind == "email":
        if len(new) == len(said):
            return "".join(c.upper() if o.isupper() else c for o, c in zip(said, new))
        return new
    if kind.startswith("name-"):
        if key is not None and _key(said) != key and _key(said) in key.split(" "):
            new = new.split(" ")[key.split(" ").index(_key(said))]
        new = re.sub(r"(?<=\w)σ(?!\w)", "ς", new)  # lost where case is folded
        if said.isupper() and said != said.lower() and len(said) > 1:
            return new.upper()
        return re.sub(r"[^\W\d_]+", lambda m: m[0].capitalize(), new)
    return new


MENTIONS = "array<struct<a:int,b:int,kind:string,key:string>>"


def with_mentions(docs: DataFrame, column: str) -> DataFrame:
    @F.pandas_udf(MENTIONS)
    def of(col: pd.Series) -> pd.Series:
        return col.map(find)

    return docs.withColumn(column, of(F.col("text").cast("string")))


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, key, new): a surrogate for each distinct entity; none equals an entity, or another's of its kind.

    A name is one entity whatever its titles; its surrogate has the gender that they agree on, if they do.
    """
    salt = secret.encode()

    def derive(rows: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def of(like: pd.Series, key: pd.Series, attempt: pd.Series) -> pd.Series:
            return pd.Series([surrogate(k, e, n, salt) for k, e, n in zip(like, key, attempt)], dtype=object)

        return rows.select("kind", "like", "key", "attempt", of("like", "key", "attempt").alias("new"))

    base = F.regexp_replace("kind", "^(name-.*)-[mfn]$", "$1")
    kinds = settle(entities.select(base.alias("base"), "kind", "key").distinct())
    tells = F.when(~F.col("kind").endswith("-n") | (F.col("base") == F.col("kind")), F.col("kind"))
    agreed = F.when(F.min(tells) == F.max(tells), F.min(tells)).otherwise(F.concat("base", F.lit("-n")))
    real = settle(kinds.groupBy("base", "key").agg(agreed.alias("like")).select(F.col("base").alias("kind"), "like", "key"))
    held = settle(derive(real.withColumn("attempt", F.lit(0))))
    while True:
        # the first of those that share a surrogate keeps it; a real entity's form is given to none
        first = held.groupBy("kind", "new").agg(F.min(F.struct("attempt", "key")).alias("first"), F.count("*").alias("c"))
        taken = real.select("kind", F.col("key").alias("new"), F.lit(True).alias("real"))
        judged = held.join(first, ["kind", "new"]).join(taken, ["kind", "new"], "left").select(
            "kind", "like", "key", "attempt", "new", (F.col("real").isNotNull() | (F.col("first.key") != F.col("key"))).alias("again")
        )
        judged = settle(judged)
        forget(held)
        if judged.where("again").isEmpty():
            new = judged.select(F.col("kind").alias("base"), "key", "new")
            return kinds.join(new, ["base", "key"]).select("kind", "key", "new")
        once_more = derive(judged.where("again").select("kind", "like", "key", (F.col("attempt") + 1).alias("attempt")))
        held = settle(judged.where("not again").select("kind", "like", "key", "attempt", "new").union(once_more))


def secret_of(spark: SparkSession) -> str:
    """The key of the surrogates: the session's spark.plenum.pii.key. Without one, a public key stands in, so that results of tests and
    checks can be compared; then anybody who knows an entity can derive its surrogate."""
    return spark.conf.get("spark.plenum.pii.key", None) or "plenum"


def pseudonymise(docs: DataFrame, secret: str | None = None) -> DataFrame:
    """docs with the mentions in `text` replaced, and one more column, n_entities (mentions; 0 for a null text).

    Texts without a mention, nulls and empty ones stay as they are; texts of any length are read whole. Repeated rows stay, and say
    the same; all other columns stay, whatever their names (a column n_entities is replaced). An empty table stays empty.
    Only texts with mentions are moved: their mentions are joined to the surrogates and gathered by row.
    """
    found, row, theirs = fresh(docs, "mentions"), fresh(docs, "row"), fresh(docs, "swaps")
    columns = [c for c in docs.columns if c != "n_entities"]
    told = with_mentions(docs.select(*[F.col(f"`{c}`") for c in columns]), found)
    some = settle(told.where(F.size(found) > 0).withColumn(row, F.monotonically_increasing_id()))
    each = some.select(row, F.explode(found).alias("m")).select(row, "m.*")
    new = assign(each, secret or secret_of(docs.sparkSession))
    swaps = each.join(new, ["kind", "key"]).groupBy(row).agg(F.array_sort(F.collect_list(F.struct("a", "b", "kind", "new", "key"))).alias(theirs))

    @F.pandas_udf("string")
    def replaced(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, swaps in parts:
            done = []
            for text, swap in zip(texts, swaps):
                out, at = [], 0
                for s in swap:
                    out += [text[at : s["a"]], render(s["kind"], text[s["a"] : s["b"]], s["new"], s["key"])]
                    at = s["b"]
                done.append("".join([*out, text[at:]]))
            yield pd.Series(done, dtype=object)

    here = [F.col(f"`{c}`") for c in columns]
    done = some.join(swaps, row).withColumn("text", replaced(F.col("text").cast("string"), F.col(theirs))).select(*here, F.size(found).cast("long").alias("n_entities"))
    plain = told.where(F.col(found).isNull() | (F.size(found) == 0)).select(*here, F.lit(0).cast("long").alias("n_entities"))
    return plain.unionByName(done)
