"""Variant spellings of persons and organisations (problem 4).

Candidates by MinHash banding over padded q-grams, the number of bands set from the collision curve, and by keys that
similar spellings always share; verified by Monge-Elkan similarity with a token similarity that knows typing errors, initials
and short names; clustered by stars: each spelling joins the one centre that it is most similar to. `linked_rows` takes the
directory's entries as centres, `star_clusters` also finds centres among the spellings, for those whose entity isn't in the directory.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions.arrow import flat_map
from mailweave.session import cut_lineage

# Short forms of given names in common use in several languages, by the full form without accents.
SHORT_NAMES = {
    "aaron": "ron ronnie", "abigail": "gail abby abi", "abraham": "abe bram", "adelaide": "addie heidi", "adrian": "ade", "agnes": "aggie nessa", "albert": "al bert bertie", "aleksandra": "ola sasha", "alejandro": "alex jandro ale",
    "alexander": "alex sasha al xander sandy", "alexandra": "alex sandra sasha lexi", "alfred": "alf fred alfie", "alice": "ali", "alison": "ali", "amanda": "mandy", "anastasia": "nastya stasia ana asya", "andrea": "andi drea",
    "andreas": "andi", "andrew": "andy drew", "angela": "angie geli", "anna": "annie anya", "anthony": "tony ant", "antonia": "toni", "antonio": "toni tonio", "archibald": "archie", "arthur": "art artie", "augustin": "gus",
    "barbara": "barb babs basia", "bartholomew": "bart barry", "bartosz": "bartek", "beatrice": "bea trixie", "benedikt": "ben", "benjamin": "ben benny", "bernadette": "bernie", "bernard": "bernie", "bernhard": "bernd", "bridget": "biddy",
    "carolina": "caro lina", "caroline": "carrie caro", "catherine": "cathy kate cat", "charles": "charlie chuck chas", "charlotte": "charlie lottie", "christian": "chris", "christina": "chris tina christa", "christine": "chris tine",
    "christopher": "chris kit topher", "constance": "connie", "cornelia": "conny nelly", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davey", "deborah": "debbie deb debby", "dmitri": "dima mitya", "dolores": "lola loli",
    "dominik": "domi", "donald": "don donnie", "dorothea": "dora thea", "dorothy": "dot dottie", "eberhard": "ebi", "edmund": "ed ned", "eduardo": "edu lalo", "edward": "ed eddie ned ted", "eleanor": "ellie nell nora", "ekaterina": "katya kate katia",
    "elena": "lena", "elisabeth": "lisa lisbeth else sissi", "elizabeth": "liz beth betty eliza lizzie", "emanuel": "manny manu", "emily": "em emmy", "enrique": "quique kike", "ernest": "ernie", "eugene": "gene", "evgeny": "zhenya", "felicia": "fee",
    "fernando": "nando fer", "florence": "flo florrie", "frances": "fran fanny", "francesca": "franca cesca", "francis": "frank fran", "francisco": "paco pancho fran cisco curro", "franziska": "franzi", "frederick": "fred freddie", "friedrich": "fritz fred freddy",
    "gabriel": "gabe", "gabriela": "gabi", "geoffrey": "geoff jeff", "george": "georgie", "gerald": "gerry jerry", "gertrude": "trudy gerti", "gianluca": "luca", "giovanni": "gianni nino vanni", "giuseppe": "beppe pino peppe", "gregory": "greg", "guillermo": "memo guille willy",
    "hannelore": "hanne lore", "harold": "hal harry", "heinrich": "heinz heiner", "helen": "nell", "helena": "lena", "henrietta": "etta hetty", "henry": "harry hank hal", "herbert": "herb bert", "hirotaka": "hiro taka", "hubert": "hugh bert",
    "ignacio": "nacho", "ignatius": "iggy nate", "irina": "ira", "isabel": "isa bella", "isabella": "bella izzy", "ivan": "vanya", "jacob": "jake", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess", "joachim": "jochen achim",
    "johannes": "hannes hans jo johann", "john": "jack johnny", "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey", "josephine": "josie jo fifi", "joshua": "josh", "judith": "judy", "katarzyna": "kasia", "katharina": "kathi", "katherine": "kate kathy katie kitty",
    "kenneth": "ken kenny", "kimberly": "kim", "kristina": "kris tina", "lawrence": "larry", "leonardo": "leo leon nardo", "ludwig": "lutz", "magdalena": "lena magda", "malgorzata": "gosia", "manuel": "manolo manu", "margaret": "peggy maggie meg marge", "maria": "mia",
    "matthew": "matt", "matthias": "matze", "maximilian": "max", "michael": "mike mick micky", "mikhail": "misha", "natalia": "natasha talia", "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "nikolai": "kolya", "oluwaseun": "seun", "padmavathi": "padma",
    "patricia": "pat patty trish", "patrick": "pat paddy", "penelope": "penny nell", "peter": "pete", "philip": "phil", "rafael": "rafa", "ramon": "moncho mon", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick richie rich", "robert": "bob rob bobby bert",
    "ronald": "ron", "samuel": "sam", "sergei": "seryozha", "stanislaw": "staszek stan stach", "stephen": "steve", "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "venkatesh": "venky venkat", "victoria": "vicky", "vladimir": "vova volodya",
    "wilhelm": "willi", "wilhelmina": "mina willa minnie", "william": "bill will billy willy", "yevgenia": "zhenya genia",
}
# Words of organisations' names that say nothing about which one it is.
LEGAL = {"ltd", "limited", "gmbh", "ag", "ab", "bv", "sa", "inc", "pvt", "co", "company", "corp", "sons", "and", "the", "llc", "kg", "plc", "oy", "as", "incorporated", "corporation", "private", "gmbh"}
TITLES = {"dr", "mr", "mrs", "ms", "prof", "ing", "dipl", "herr", "frau", "ext", "mme", "sr"}
MACHINES = re.compile(r"no.?reply|mail delivery|automatic reply|mailer.?daemon|postmaster|undisclosed|system", re.I)
_SHORTS = {k: frozenset(v.split()) for k, v in SHORT_NAMES.items()}

ROWS_PER_BAND = 2
Q = 3


def bands_for(similarity: float, recall: float, rows: int = ROWS_PER_BAND) -> int:
    """Bands so that a pair of this Jaccard similarity collides with at least this probability: 1-(1-s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


#: A short form with one typing error still shares 0.4 of its q-grams with one of the centre's forms.
BANDS = bands_for(0.4, 0.995)
#: Words from this length on have their ends as keys instead of their deletions; spellings of more words than this have keys of single words.
LONG_WORD, MANY_WORDS = 24, 12
_SEEDS = np.random.RandomState(7).randint(1, 2**62, size=(BANDS * ROWS_PER_BAND, 1)).astype(np.uint64) | np.uint64(1)


def fold(text: str) -> str:
    """Lower case without accents."""
    if not text.isascii():
        text = text.replace("ł", "l").replace("Ł", "L").replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("đ", "d")
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.lower()


@lru_cache(maxsize=50_000)
def tokens(name: str) -> tuple[str, ...]:
    """Words of a spelling without titles, remarks, quotes and a company after a slash."""
    name = re.sub(r"\([^)]*\)", " ", name)
    name = re.sub(r"\s/\s.*", " ", name)
    name = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\.)", r"\1 ", name) if not re.search(r"\b(?:B\.V|S\.A|L\.L\.C)\b", name) else re.sub(r"\bB\.\s?V\.?", "bv", re.sub(r"\bS\.\s?A\.?", "sa", name))
    words = re.findall(r"[^\W\d_]+", fold(name))
    return tuple(w for w in words if w not in TITLES)


@lru_cache(maxsize=50_000)
def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1 or min(la, lb) < 4:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def token_similarity(word: str, full: str, given: bool) -> float:
    """Of a word of a spelling to a word of the directory; given: the word is a given name."""
    if word == full:
        return 1.0
    if given:
        if len(word) == 1:
            return 0.85 if full[0] == word else 0.0
        shorts = _SHORTS.get(full, frozenset())
        if word in shorts:
            return 0.95
        if len(word) > 3 and any(len(s) > 3 and near(word, s) for s in shorts):
            return 0.9
    return 1 - 1 / max(len(word), len(full)) if near(word, full) else 0.0


def monge_elkan(spelling: tuple[str, ...], entry: tuple[str, ...]) -> float:
    """Mean over the entry's words (given names, then family name) of the best similarity of a word of the spelling.

    0 unless the family name is met, a given name (in full, short or as initial) is met by another word, and every
    longer word of the spelling is met: an unexplained word means somebody else.
    """
    if len(spelling) == 1:
        w, family, given = spelling[0], entry[-1], entry[0]
        if near(w, given[0] + family) and w != family and w[0] == given[0]:
            return 0.88
        if near(w, given + family):
            return 0.95
        if w == family or near(w, family):
            return 0.8 if w == family else 0.78
        return 0.0
    best, family_at = 0.0, -1
    for i, w in enumerate(spelling):
        s = token_similarity(w, entry[-1], False)
        if s > best:
            best, family_at = s, i
    if best == 0.0:
        return 0.0
    total, used = best, {family_at}
    rest = [(i, w) for i, w in enumerate(spelling) if i != family_at]
    for given in entry[:-1]:
        s, at = max(((token_similarity(w, given, True), -i) for i, w in rest if i not in used), default=(0.0, 0))
        if s == 0.0:
            return 0.0
        if s == 0.85 and rest[0][0] != -at:  # initials keep their order: the first one is the given name's
            return 0.0
        total += s
        used.add(-at)
    if any(len(w) > 1 for i, w in rest if i not in used):
        return 0.0
    return total / len(entry)


def organisation_similarity(spelling: tuple[str, ...], entry: tuple[str, ...]) -> float:
    """The distinctive first word must be met, every other word be one of the entry's, an abbreviation of it, or a legal form."""
    words = [w for w in spelling if w != "the"]
    if not words or not near(words[0], entry[0]) or len(words[0]) < 4:
        return 0.0
    total = 1.0 if words[0] == entry[0] else 1 - 1 / len(entry[0])
    for w in words[1:]:
        if w in LEGAL or len(w) <= 2:
            continue
        if not any(near(w, e) or (len(w) >= 2 and e.startswith(w)) for e in entry[1:]):
            return 0.0
    return total


def _forms(name: str, kind: str) -> list[tuple[str, ...]]:
    """The forms of a directory entry whose q-grams are indexed."""
    t = tokens(name)
    if not t:
        return []
    if kind == "organisation":
        core = tuple(w for w in t if w not in LEGAL)
        return [t, core, t[:1]]
    family = t[-1]
    return [t, (t[0][0], family), (t[0][0] + family,)] + [(s, family) for s in sorted(_SHORTS.get(t[0], ()))]


def _bands(words: Iterable[str]) -> list[int]:
    grams = {p[i : i + Q] for w in words for p in (f"##{w}##",) for i in range(len(p) - Q + 1)}
    h = np.array([xxhash.xxh64_intdigest(g) for g in grams], dtype=np.uint64)
    with np.errstate(over="ignore"):
        m = ((h * _SEEDS) ^ ((h * _SEEDS) >> np.uint64(29))).min(axis=1).reshape(BANDS, ROWS_PER_BAND)
        mixed = m[:, 0]
        for k in range(1, ROWS_PER_BAND):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) ^ (m[:, k] >> np.uint64(7))
        return (mixed ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


@lru_cache(maxsize=50_000)
def _edits(word: str) -> frozenset[str]:
    """Words that are `near` share one of these: the word and its single deletions, or an end of a long one."""
    if len(word) < 4:
        return frozenset((word,))
    out = {word}
    if len(word) <= LONG_WORD:
        out |= {word[:i] + word[i + 1 :] for i in range(len(word))}
    if len(word) >= LONG_WORD:  # no edit touches both ends
        half = (LONG_WORD - 1) // 2
        out |= {"<" + word[:half], ">" + word[-half:]}
    return frozenset(out)


def _ends(word: str) -> set[str]:
    """Words that are `near`, or of which one begins the other, share one of these short codes."""
    if len(word) < 4:
        return {"<" + word[:2]}
    return {"<" + word[:2], ">" + word[-2:]} | ({f"-{word[0]}{word[-1]}"} if len(word) == 4 else set())


def _asked(t: tuple[str, ...], firm: tuple[str, ...]) -> set[str]:
    """Keys of a spelling's words, as a person's and as an organisation's: it shares one with the `_answered` of every centre
    that it is similar to, by either similarity."""
    out = set()
    if len(t) == 1:
        out |= {"s" + e for e in _edits(t[0])}
    elif len(set(t)) > MANY_WORDS:  # any word may be the family name
        out |= {"m" + e for w in set(t) for e in _edits(w)}
    else:  # one word is the family name, another the first given name
        times = Counter(t)
        codes = {w: _ends(w) if len(w) > 1 else {"1" + w} for w in times}
        out |= {f"p{e}|{c}" for a in times for b in times if a != b or times[a] > 1 for e in _edits(a) for c in codes[b]}
    firm = tuple(w for w in firm if w != "the")
    if firm and len(firm[0]) > 3:
        other = next((w for w in firm[1:] if w not in LEGAL and len(w) > 2), None)
        out |= {f"o{e}|{c}" for e in _edits(firm[0]) for c in (_ends(other) if other else ("",))}
    return out


def _answered(name: str) -> set[str]:
    """Keys of a spelling as centre."""
    t, firm, out = entry_tokens(name), tokens(name), set()
    if len(t) > 1:
        given, family = t[0], t[-1]
        out |= {"s" + e for w in (given[0] + family, given + family, family) for e in _edits(w)}
        codes = {"1" + given[0]}.union(*(_ends(w) for w in (given, *_SHORTS.get(given, ()))))
        out |= {f"p{e}|{c}" for e in _edits(family) for c in codes} | {"m" + e for e in _edits(family)}
    if firm:
        out |= {f"o{e}|{c}" for e in _edits(firm[0]) for c in {""}.union(*(_ends(w) for w in firm[1:]))}
    return out


def _hashed(keys: Iterable[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(k) - 2**63 for k in keys]


def domain_of(address: str | None) -> str:
    return (address or "").rsplit("@", 1)[-1].split(".")[0].lower() if "@" in (address or "") else ""


#: From this similarity on a single best centre needs no domain; one at the row's domain may be so much less similar than the best.
CLEAR, HOME_MARGIN = 0.97, 0.12


def similarity(spelling: tuple[str, ...], kind: str, full: str) -> float:
    """Of a spelling's words to an entry (or another spelling taken as centre); 0 if they don't mean the same."""
    entry = entry_tokens(full)
    if kind == "organisation":
        return organisation_similarity(spelling, entry) if entry else 0.0
    return monge_elkan(spelling, entry) if len(entry) > 1 and spelling else float(spelling == entry)


def choose(name: str, domain: str, candidates: list[tuple]) -> int | None:
    """The star that a spelling joins: the centre it is most similar to; among equals the one whose company has the row's domain.

    candidates: (id, kind, name, company domain). None if no centre is similar, or if several are equally so and the domain
    doesn't tell them apart.
    """
    spelling = tokens(name)
    if not spelling or MACHINES.search(name):
        return None
    scored = [(s, pid, home) for pid, kind, full, home in candidates if (s := similarity(spelling, kind, full)) > 0]
    if not scored:
        return None
    # forms that differ only by a typing error are as good as each other: the domain decides before small differences do
    top = max(s for s, _, _ in scored)
    exact = [x for x in scored if x[0] >= top - 1e-9]
    if len(exact) == 1 and (top > CLEAR or len(scored) == 1):
        return exact[0][1]
    at_home = [x for x in scored if x[2] == domain and domain]
    if at_home:
        best = max(x[0] for x in at_home)
        first = [x for x in at_home if x[0] >= best - 1e-9]
        return first[0][1] if len(first) == 1 and best >= top - HOME_MARGIN else None
    return exact[0][1] if len(exact) == 1 else None


def resolve_spellings(spellings: DataFrame, people: DataFrame, broadcast_rows: int = 20_000) -> DataFrame:
    """(name, domain, person_id) for each distinct (name, domain) that refers to a directory entry.

    NULL and blank names, names without letters and machines refer to nobody. Ties that the domain doesn't break
    give no row. The directory is broadcast only while it has at most `broadcast_rows` entries; a larger
    one is joined by shuffle. Each spelling carries its few candidates, never pairs of spellings.
    """

    def index() -> object:
        def one(pid: int, kind: str, name: str | None, address: str | None, company: str | None) -> list[tuple]:
            if not name:
                return []
            firm = kind == "organisation"
            return [(b, pid) for b in sorted({b for f in _forms(name, kind) for b in _bands(f)}.union(_hashed(k for k in _answered(name) if (k[0] == "o") == firm)))]

        return one

    def sign() -> object:
        def one(name: str, domain: str) -> list[tuple]:
            t = tokens(name)
            if not t or MACHINES.search(name):
                return []
            out = set(_bands(t))
            core = [w for w in t if w not in LEGAL]
            if 0 < len(core) < len(t):
                out |= set(_bands(core))
            if len(core) > 1 and len(core) > 2:
                out |= set(_bands(core[:1]))
            out |= set(_hashed(_asked(t, t)))
            return [(name, domain, sorted(out))]

        return one

    directory = people.select("person_id", "kind", "name", "address", "company").where("person_id IS NOT NULL AND name IS NOT NULL")
    entries = flat_map(directory, index, "band long, pid long")
    signed = flat_map(spellings.select("name", "domain"), sign, "name string, domain string, bands array<long>").select("name", "domain", F.explode("bands").alias("band"))
    small = directory.limit(broadcast_rows + 1).count() <= broadcast_rows
    if small:
        entries = F.broadcast(entries)
    found = signed.join(entries, "band").groupBy("name", "domain").agg(F.collect_set("pid").alias("c"))  # at most the directory's entries
    describe = lambda pid, kind, name, address, company: (pid, kind or "person", name, domain_of(address) or (tokens(company or "") or ("",))[0])
    if small:
        known = directory.sparkSession.sparkContext.broadcast({r[0]: describe(*r) for r in directory.collect()})

        def verify() -> object:
            entry = known.value

            def one(name: str, domain: str, c: list[int]) -> list[tuple]:
                pid = choose(name, domain, [entry[x] for x in sorted(c)])
                return [] if pid is None else [(name, domain, pid)]

            return one

        return flat_map(found, verify, "name string, domain string, person_id long")

    # a directory too large to send: its entries come to the candidates by shuffle, one row each, and are judged row by row
    rows = signed.join(entries, "band").select("name", "domain", F.col("pid").alias("person_id")).distinct().join(directory.withColumnRenamed("name", "full"), "person_id")

    def score() -> object:
        def one(name: str, domain: str, *entry: object) -> list[tuple]:
            pid, kind, full, home = describe(*entry)
            s = similarity(tokens(name), kind, full)
            return [(name, domain, pid, round(s, 9), home == domain and bool(domain))] if s > 0 else []

        return one

    scored = flat_map(rows.select("name", "domain", "person_id", "kind", "full", "address", "company"), score, "name string, domain string, person_id long, score double, home boolean")
    equal = scored.groupBy("name", "domain", "score").agg(F.count("*").alias("n"), F.min("person_id").alias("pid"), F.count_if("home").alias("nh"), F.min(F.when(F.col("home"), F.col("person_id"))).alias("ph"))
    best = equal.groupBy("name", "domain").agg(F.max(F.struct("score", "n", "pid")).alias("top"), F.sum("n").alias("all"), F.max(F.when(F.col("nh") > 0, F.struct("score", "nh", "ph"))).alias("home"))
    only = F.when(F.col("top.n") == 1, F.col("top.pid"))
    clear = (F.col("top.n") == 1) & ((F.col("top.score") > CLEAR) | (F.col("all") == 1))
    at_home = F.when((F.col("home.nh") == 1) & (F.col("home.score") >= F.col("top.score") - HOME_MARGIN), F.col("home.ph"))
    chosen = F.when(clear, only).when(F.col("home").isNotNull(), at_home).otherwise(only)
    return best.select("name", "domain", chosen.alias("person_id")).where("person_id IS NOT NULL")


def entry_tokens(name: str) -> tuple[str, ...]:
    """The words of a spelling in the order of a directory entry: what stands before a comma is the family name."""
    family, comma, given = name.partition(",")
    return tokens(given) + tokens(family) if comma and tokens(given) else tokens(name)


def star_similarity(name: str, full: str) -> tuple[float, bool]:
    """Of a spelling to another as centre, and whether as persons; else as organisations, where initials must be met as well:
    what kind they are isn't known, and initials tell apart the persons of one family name."""
    person = similarity(entry_tokens(name), "person", full)
    if person > 0:
        return person, True
    spelling, entry = tokens(name), tokens(full)
    if any(len(w) <= 2 and w not in LEGAL and w not in entry for w in spelling):
        return 0.0, False
    return organisation_similarity(spelling, entry), False


def centres_of(live: DataFrame, edges: DataFrame) -> DataFrame:
    """(centre) of all stars. live has words and rank; edges has words, centre and the ranks of both (rank, best), each pair one way."""
    centres = live.select(F.col("words").alias("centre")).limit(0)
    while not live.isEmpty():  # who has no better neighbour left opens a star, its neighbours leave
        opened = cut_lineage(live.join(edges, "words", "left_anti").select(F.col("words").alias("centre")))
        if opened.isEmpty():  # a ring, as some pairs are against the ranks: who ranks first among its neighbours breaks it
            beaten = edges.select(F.when(F.col("rank") < F.col("best"), F.col("words")).otherwise(F.col("centre")).alias("words"))
            opened = cut_lineage(live.join(beaten, "words", "left_anti").select(F.col("words").alias("centre")))
        centres = centres.unionByName(opened)
        gone = cut_lineage(edges.join(opened, "centre", "left_semi").select("words").unionByName(opened.select(F.col("centre").alias("words"))).distinct())
        live = cut_lineage(live.join(gone, "words", "left_anti"))
        edges = cut_lineage(edges.join(gone, "words", "left_anti").join(gone.withColumnRenamed("words", "centre"), "centre", "left_anti"))
    return cut_lineage(centres)


def star_clusters(spellings: DataFrame, people: DataFrame) -> DataFrame:
    """(name, cluster, person_id) for each distinct spelling: the centre's name, and its directory entry if it is one.

    spellings has name. The directory's entries are centres first (resolve_spellings, without domains). Of the spellings that
    are left every similar pair is found: who is similar to a centre shares a key with it (`_asked`, `_answered`), so pairs
    that mean different entities rarely meet, and no similar one is missed by chance. Of a pair the better spelling (full names
    before short ones, then how often it occurs) is the centre, unless as persons only the other one can be: Bob is short for
    Robert, not the reverse. A spelling without a better similar one opens a star, its similar ones leave, and the rest goes again. Then each
    joins the star that it is most similar to of all. Names without letters, machines and NULLs have no row. Words that agree
    in any order are one spelling, which is similar to what one of its orders is similar to.
    """

    def sign() -> object:
        def one(name: str, n: int) -> list[tuple]:
            t = entry_tokens(name)
            if not t or MACHINES.search(name):
                return []
            return [(name, " ".join(sorted(t)), " ".join((*t, "/", *tokens(name))), n, int(sum(len(w) > 1 for w in t) > 1))]

        return one

    given = cut_lineage(spellings.where("length(trim(name)) > 0").groupBy("name").agg(F.count("*").alias("n")))
    entries = people.where("person_id IS NOT NULL AND length(trim(name)) > 0").select(F.col("name").alias("cluster"), F.col("person_id").cast("long").alias("person_id"))
    known = cut_lineage(resolve_spellings(given.select("name", F.lit("").alias("domain")), people).select("name", "person_id").join(entries, "person_id").select("name", "cluster", "person_id"))
    signed = cut_lineage(flat_map(given.join(known, "name", "left_anti"), sign, "name string, words string, form string, n long, class int"))
    node = signed.groupBy("words").agg(F.sum("n").alias("n"), F.max(F.struct("class", "n", "name")).alias("x")).select("words", "n", F.col("x.class").alias("class"), F.col("x.name").alias("name"))
    node = cut_lineage(node.withColumn("rank", F.struct("class", "n", F.xxhash64("words").alias("h"), "words")))
    forms = cut_lineage(signed.groupBy("words", "form").agg(F.min("name").alias("name")))

    def keys() -> object:
        return lambda words, name: [(k, words, name, True) for k in _hashed(_asked(entry_tokens(name), tokens(name)))] + [(k, words, name, False) for k in _hashed(_answered(name))]

    def verify() -> object:
        def one(words: str, name: str, centre: str, full: str) -> list[tuple]:
            s, person = star_similarity(name, full)
            return [(words, centre, s, person)] if s > 0 else []

        return one

    keyed = cut_lineage(flat_map(forms.select("words", "name"), keys, "key long, words string, name string, asks boolean"))
    centre = keyed.where("NOT asks").select("key", F.col("words").alias("centre"), F.col("name").alias("full"))
    asked = keyed.where("asks").join(centre, "key").where("words <> centre").select("words", "name", "centre", "full").distinct()
    similar = flat_map(asked, verify, "words string, centre string, score double, person boolean").groupBy("words", "centre").agg(F.max("score").alias("score"), F.max("person").alias("person"))
    ranks = node.select("words", "rank")
    similar = cut_lineage(similar.join(ranks, "words").join(ranks.select(F.col("words").alias("centre"), F.col("rank").alias("best")), "centre"))
    way = F.struct("person", F.col("rank") < F.col("best"), "score", "words", "centre", "rank", "best")
    pairs = similar.where("person OR rank < best").groupBy(F.least("words", "centre"), F.greatest("words", "centre")).agg(F.max(way).alias("w"))
    edges = cut_lineage(pairs.select("w.words", "w.centre", "w.score", "w.rank", "w.best"))
    centres = centres_of(ranks, edges)
    joined = edges.join(centres, "centre", "left_semi").join(centres.withColumnRenamed("centre", "words"), "words", "left_anti").groupBy("words").agg(F.max(F.struct("score", "best")).alias("b")).select("words", F.col("b.best.words").alias("centre"))
    stars = joined.unionByName(centres.select(F.col("centre").alias("words"), "centre"))
    heads = node.select(F.col("words").alias("centre"), F.col("name").alias("cluster"), F.lit(None).cast("long").alias("person_id"))
    return known.unionByName(signed.select("name", "words").join(stars, "words").join(heads, "centre").select("name", "cluster", "person_id"))


def linked_rows(rows: DataFrame, people: DataFrame) -> DataFrame:
    """rows (tab, rec_id, name, address) that refer to an entry of people but aren't written exactly as its name, with person_id."""
    x = rows.where("length(trim(name)) > 0").select("tab", "rec_id", "name", F.coalesce(F.lower(F.regexp_extract("address", r"@([^.@]+)", 1)), F.lit("")).alias("domain"))
    known = resolve_spellings(x.select("name", "domain").distinct(), people)
    variants = known.join(people.select("person_id", F.col("name").alias("full")), "person_id").where("name <> full").select("name", "domain", "person_id")
    return x.join(variants, ["name", "domain"]).select("tab", "rec_id", "person_id")
