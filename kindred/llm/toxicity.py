"""Toxicity by weak supervision.

Voters look at a text and vote "toxic" or abstain: lexicons and patterns of four languages, and lexicons mined from training
rows, each of which holds the words with a common stem and votes if enough of them stand in the text.  Gold labels of training rows only choose the
mined lexicons and drop fixed words that stand in clean rows.  A generative label model is then fitted by expectation-maximisation over the votes alone, without
any label: each voter has a rate of voting on toxic and on clean rows (its accuracy), and voters that agree more than these rates explain are
correlated and share their weight.  The model's posteriors label the sample, and a linear classifier is trained on them; it alone scores documents.

Training uses at most ``SAMPLE`` labelled rows, those with the smallest hashes of their doc_id (a bounded sample whose size
doesn't depend on the corpus; rows that repeat a doc_id count once each, in one row of equal votes).  Scoring reads every whole text.  Labels, language,
source and doc_id are not inputs of a score.

Defined cases: a null text is scored as an empty one; an empty text gets the classifier's bias alone; without usable
labels the fixed voters are all there are, and where none of them votes all voters get one preset weight.
Labels that are null or repeat a doc_id are ignored or counted once (toxic if any says so).  A row without a doc_id isn't
held out.  Repeated rows get equal scores; an empty table gives an empty result.  :func:`scored` carries other columns along and replaces
one named like its result, in any case; :func:`without_toxic` returns the columns as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kindred.llm.workspace import Workspace, ship

SAMPLE = 12_000
THRESHOLD = 0.7
#: Stems: whole words, and prefixes of so many characters.  A learned lexicon votes from 1, 2, ... ``MOST`` of its words on.
PREFIXES, MOST = (3, 4, 5, 6), 4
#: Learned lexicons: at most so many, each with this support and precision, and a likelihood ratio that chance hardly gives.
LEARNED, MIN_SUPPORT, MIN_PRECISION, MIN_RATIO = 240, 5, 0.88, 12.0
EM_ROUNDS, TRAIN_ROUNDS, RIDGE = 30, 40, 0.1
#: Label model: share of toxic rows; belief in "toxic" at first, by number of votes; rates of voting on toxic and on clean rows that a voter has without
#: evidence, with the rows that this counts for; how much more often a voter votes on toxic rows at least, and the precision that mining stands for.
PRIOR, FIRST_BELIEFS, USUAL, BETTER, MINED_PRECISION = 0.1, (0.02, 0.5, 0.95), ((0.1, 4.0), (0.002, 20.0)), 3.0, 0.95
#: How much it says that a voter abstains; less than all, as voters of one language or topic abstain on the others.
ABSTAINED = 0.5
#: A word of a fixed lexicon is left out if so many training rows hold it and fewer than half of them are toxic.
MIN_ROWS = 5

#: Lexicon voters, one a topic and language.
LEXICONS = {
    "stupid, en": "airhead birdbrain blockhead brainless cretin dense dimwit dolt dope dumb dumbass dunce fool fools halfwit idiot idiotic idiots imbecile moron moronic morons nitwit numbskull simpleton stupid stupidity",
    "worthless, en": "abject contemptible deplorable despicable disgrace disgraceful disgusting failure hopeless inferior lame loser losers miserable nobody pathetic pitiful repulsive revolting sickening useless vile worthless wretched",
    "dehumanising, en": "animal animals beast cockroach cockroaches dirt filth filthy garbage leech maggot parasite parasites pest pig pigs rat rats rubbish savage savages scum swine trash vermin worm",
    "mocking, en": "clown clowns crybaby coward cowards creep freak freaks joke jerk laughable liar liars ridiculous snowflake weirdo whiner",
    "vulgar, en": "arse arsehole ass asshole bastard bitch bloody bollocks bullshit crap cunt damn dick dickhead douche fuck fucked fucker fucking piss prick shit shitty slut twat wanker whore",
    "threat, en": "attack beat burn crush destroy exterminate hang hurt kill murder punch shoot slap stab strangle",
    "stupid, fr": "abruti abrutis andouille bête bouffon bouffons crétin crétins débile débiles idiot idiote idiots imbécile imbéciles stupide stupides taré tarés",
    "vulgar, fr": "bâtard chiant chier connard connards connasse couille emmerde enculé enculés foutre merde merdique ordure ordures pourriture pute putes putain salaud salope salopes vermine",
    "threat, fr": "brûler crever crève détruire écraser frapper pendre tuer tuez",
    "stupid, de": "blöd blöde blödmann deppen depp doof dumm dumme dummkopf dummköpfe hirnlos idiot idioten schwachkopf schwachsinnig trottel volltrottel vollidiot",
    "vulgar, de": "abschaum arsch arschloch arschlöcher dreck dreckig dreckskerl fick ficken fotze hure hurensohn miststück missgeburt sau scheiß scheiße scheisse schlampe schwein schweine ungeziefer wichser",
    "threat, de": "aufhängen erschießen erschlagen töten umbringen verprügeln verrecke verrecken vernichten",
    "stupid, es": "estúpida estúpido estúpidos idiota idiotas imbécil imbéciles inútil inútiles necio payaso payasos retrasado tarado tonta tonto tontos torpe",
    "vulgar, es": "asqueroso basura bastardo cabrón cabrones carajo coño escoria gilipollas hijueputa joder maldito mierda pendejo pendejos perra puta putas puto zorra",
    "threat, es": "ahorcar aplastar destruir golpear matar muérete quemar",
}
#: Pattern voters over the lower-cased text, and words of which a text needs one for the pattern to be tried.
PATTERNS = {
    "second person, en": (r"\byou(?:'re| are)? (?:all |just |such )?(?:a |an |the )?(?:\w+ )?(?:idiots?|morons?|losers?|clowns?|trash|scum|stupid|pathetic|worthless|disgusting|vermin|fools?)\b", "you"),
    "wish of harm, en": (r"\b(?:go|should|must|deserve to) (?:and )?(?:die|hang|burn|kill yourself)\b", "die hang burn kill"),
    "shut up, en": (r"\bshut (?:the \w+ )?up\b", "shut"),
    "group, en": (r"\b(?:those|these|all|such) \w+ (?:are|should be) (?:vermin|scum|trash|animals|pigs|parasites)\b", "vermin scum trash animals pigs parasites"),
    "hate, en": (r"\b(?:i|we|everyone|everybody) (?:all )?(?:hates?|despises?|loathes?) (?:you|them|those|these)\b", "hate hates despise despises loathe loathes"),
    "get out, en": (r"\b(?:go back to (?:your|where)|get out of (?:my|our))\b", "back out"),
    "second person, fr": (r"\b(?:tu es|t'es|vous êtes|espèces? d[e'])\s?(?:un |une |des |vraiment )?(?:idiot|abruti|con|crétin|débile|ordure|nul)", "tu t vous espèce espèces"),
    "shut up, fr": (r"\b(?:ferme[sz]? (?:ta gueule|la)|ta gueule)\b", "gueule ferme fermez"),
    "second person, de": (r"\b(?:du|ihr|sie) (?:bist|seid|sind) (?:ein |eine |so |nur |doch )?(?:idiot|dumm|trottel|abschaum|arschloch|dreck|blöd)", "bist seid sind"),
    "shut up, de": (r"\b(?:halt|haltet) (?:die|dein|deine|euer) (?:fresse|maul|klappe)\b", "fresse maul klappe"),
    "second person, es": (r"\b(?:eres|sois|son) (?:un |una |unos |muy |tan )?(?:idiota|imbécil|estúpid|basura|escoria|tont|inútil)", "eres sois son"),
    "shut up, es": (r"\b(?:cállate|cierra la boca|vete a la mierda)\b", "cállate boca vete"),
}
#: A vulgar word with letters hidden, in any language.
MASKED = r"\b[a-z]{1,2}[*#@$]{2,}[a-z]{1,4}\b"
_PATTERNS = [(re.compile(p), frozenset(w.split())) for p, w in PATTERNS.values()]
_MASKED, _HIDING = re.compile(MASKED), ("**", "##", "@@", "$$", "*#", "#*", "@#", "$#")
_WORD = re.compile(r"[^\W\d_]+")
#: Voters that are fixed.
FIXED = len(LEXICONS) + len(_PATTERNS) + 1


def stems(word: str) -> list[str]:
    """A word (``=word``) and its prefixes (``word*``)."""
    return [f"={word}", *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Model(NamedTuple):
    """Learned lexicons ``(stem, words needed)``, words left out of the fixed ones, and the classifier's weights of all voters: lexicons, patterns, learned."""

    learned: list[tuple[str, int]]
    dropped: list[str]
    weights: np.ndarray
    bias: float


class Voters:
    """Finds the votes of one text."""

    def __init__(self, learned: list[tuple[str, int]], dropped: list[str] | None = None) -> None:
        self.at: dict[str, list[int]] = {}
        for i, words in enumerate(LEXICONS.values()):
            for w in set(words.split()).difference(dropped or ()):
                self.at.setdefault(f"={w}", []).append(i)
        for i, (stem, _) in enumerate(learned):
            self.at.setdefault(stem, []).append(FIXED + i)
        self.need = [1] * FIXED + [n for _, n in learned]
        self.count = len(self.need)
        self.words: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = tuple(sorted({i for s in stems(word) for i in self.at.get(s, ())}))
        if len(word) <= 64:  # longer ones aren't kept, as words may be arbitrarily long
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[word] = found
        return found

    def votes(self, text: str | None) -> list[int]:
        """The voters that vote on the whole text."""
        if not text:
            return []
        low = text.lower()
        words, seen, known = Counter(_WORD.findall(low)), {}, self.words
        for word, n in words.items():
            found = known.get(word)
            if found is None:
                found = self.of_word(word)
            for i in found:
                seen[i] = seen.get(i, 0) + n
        out = [i for i, n in seen.items() if n >= self.need[i]]
        for i, (pattern, some) in enumerate(_PATTERNS, len(LEXICONS)):
            if not some.isdisjoint(words) and pattern.search(low):
                out.append(i)
        if any(h in low for h in _HIDING) and _MASKED.search(low):
            out.append(FIXED - 1)
        return out


class LabelModel(NamedTuple):
    """Rates of voting on toxic and on clean rows, share of toxic rows, and how voters are correlated (0 to 1).

    Correlated voters that vote, or abstain, on the same row share their weight.
    """

    toxic: np.ndarray
    clean: np.ndarray
    prior: float
    tied: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of "toxic" given the votes."""
        absent = 1 - votes
        yes, no = (x / np.maximum(x @ self.tied, 1) for x in (votes, absent))
        logit = np.log(self.prior / (1 - self.prior)) + yes @ np.log(self.toxic / self.clean) + ABSTAINED * (no @ np.log((1 - self.toxic) / (1 - self.clean)))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def least_ratios(count: int) -> np.ndarray:
    """How much more often each voter is held to vote on toxic rows: fixed ones ``BETTER`` times, mined ones as a precision of ``MINED_PRECISION`` asks."""
    return np.where(np.arange(count) < FIXED, BETTER, (1 - PRIOR) / PRIOR * MINED_PRECISION / (1 - MINED_PRECISION))


def fit_label_model(votes: np.ndarray, counts: np.ndarray | None = None, better: np.ndarray | float = 3.0, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over ``votes`` alone, rows counted ``counts`` times; no label is read.

    The first beliefs come from how many voters vote (``FIRST_BELIEFS``).  The share of toxic rows is fixed (``PRIOR``), and every voter is held to vote at least
    ``better`` times as often on toxic rows as on clean ones; else "toxic" could come to mean the rows that no one votes on.
    """
    counts = np.ones(len(votes)) if counts is None else counts.astype(float)
    belief = np.array(FIRST_BELIEFS)[np.minimum(votes.sum(axis=1), len(FIRST_BELIEFS) - 1).astype(int)]
    model = LabelModel(np.full(votes.shape[1], USUAL[0][0]), np.full(votes.shape[1], USUAL[1][0]), PRIOR, np.eye(votes.shape[1]))
    for _ in range(rounds):
        toxic, clean = (((part * counts) @ votes + strength * usual) / ((part * counts).sum() + strength) for part, (usual, strength) in zip((belief, 1 - belief), USUAL))
        toxic, clean = np.clip(toxic, 1e-3, 0.99), np.clip(np.minimum(clean, toxic / better), 1e-6, 0.33)
        model = LabelModel(toxic, clean, PRIOR, _ties(votes, counts, belief, toxic, clean))
        new = model.posterior(votes)
        if np.abs(new - belief).max(initial=0) < 1e-4:
            break
        belief = new
    return model


def _ties(votes: np.ndarray, counts: np.ndarray, belief: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Correlation of the voters beyond what the labels explain; weak ones count as none."""
    if not len(votes):
        return np.eye(votes.shape[1])
    rest = (votes - (belief[:, None] * toxic + (1 - belief)[:, None] * clean)) * np.sqrt(counts)[:, None]
    size = np.sqrt((rest**2).sum(axis=0)) + 1e-9
    tied = np.clip((rest.T @ rest) / np.outer(size, size), 0, 1)
    tied[tied < 0.2] = 0
    np.fill_diagonal(tied, 1)
    return tied


def fit_classifier(votes: np.ndarray, posterior: np.ndarray, counts: np.ndarray | None = None, rounds: int = TRAIN_ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by damped Newton steps; the bias is not shrunk."""
    counts = np.ones(len(votes)) if counts is None else counts.astype(float)
    x = np.hstack([votes.astype(float), np.ones((len(votes), 1))])
    theta, shrink = np.zeros(x.shape[1]), np.append(np.full(votes.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (counts * (posterior - p)) - shrink * theta
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(bend, slope)
        theta += step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return theta[:-1], float(theta[-1])


def fold(doc_id) -> F.Column:
    """0, 1 or 2: ``crc32`` of the doc_id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``stem, need, clean, toxic``: rows of either label with at least ``need`` words of the stem."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            counts: dict[tuple[str, int], list[int]] = {}
            part = batch.slice(at, 256)
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                held: dict[str, int] = {}
                for word, n in Counter(_WORD.findall((text or "").lower())).items():
                    if len(word) <= 64:
                        for stem in stems(word):
                            held[stem] = held.get(stem, 0) + n
                for stem, n in held.items():
                    for need in range(1, min(n, MOST) + 1):
                        counts.setdefault((stem, need), [0, 0])[toxic] += 1
            cols = [[k[0] for k in counts], [k[1] for k in counts], [c[0] for c in counts.values()], [c[1] for c in counts.values()]]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["stem", "need", "clean", "toxic"])


def learn_lexicons(rows: DataFrame) -> tuple[list[tuple[str, int]], list[str]]:
    """From labelled rows ``(text, toxic)``: lexicons, of each stem the number of words that tells most, strongest first; and fixed words to drop."""
    ship(rows.sparkSession)
    base = rows.agg(F.avg("toxic")).first()[0]
    if not base or base == 1:
        return [], []
    counts = rows.mapInArrow(_stem_counts, "stem string, need int, clean long, toxic long").groupBy("stem", "need").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    t, c = F.col("toxic"), F.col("clean")
    precision = t / (t + c)
    ratio = t * F.log(precision / base) + F.when(c > 0, c * F.log((1 - precision) / (1 - base))).otherwise(0.0)
    good = counts.where((t >= MIN_SUPPORT) & (precision >= MIN_PRECISION)).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    best = good.groupBy("stem").agg(F.max(F.struct("ratio", -F.col("need"), "need", "toxic", "clean")).alias("b")).select("stem", "b.*")
    top = best.orderBy(F.desc("ratio"), F.length("stem"), "stem").limit(4 * LEARNED).collect()
    fixed = sorted({f"={w}" for words in LEXICONS.values() for w in words.split()})
    poor = counts.where(F.col("stem").isin(fixed) & (F.col("need") == 1) & (t + c >= MIN_ROWS) & (t < c)).select("stem").collect()
    counts.unpersist()
    learned: list = []
    for r in top:
        own = r.stem.strip("=*")
        # Rows of a stronger lexicon with a longer stem are rows of this one as well: it must tell something of those that it adds.
        inner = [(r.toxic - x.toxic, r.clean - x.clean) for x in learned if x.need >= r.need and x.stem.strip("=*").startswith(own)]
        equal = any(own.startswith(x.stem.strip("=*")) and x.need <= r.need and (x.toxic, x.clean) == (r.toxic, r.clean) for x in learned)
        if not equal and all(t >= MIN_PRECISION * (t + c) and t > 0 for t, c in inner):
            learned.append(r)
    return [(r.stem, r.need) for r in learned[:LEARNED]], sorted(r.stem[1:] for r in poor)


def _packed(found: list[int], count: int) -> bytes:
    row = np.zeros(count, np.uint8)
    row[found] = 1
    return np.packbits(row).tobytes()


def vote_table(rows: DataFrame, learned: list[tuple[str, int]], dropped: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of votes on ``rows(text)``, of which there are a bounded number, and how often each occurs."""
    ship(rows.sparkSession)
    count = Voters(learned).count

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(learned, dropped)
        for batch in batches:
            found = [_packed(own.votes(t.as_py()), count) for t in batch.column("text")]
            yield pa.record_batch([pa.array(found, pa.binary())], names=["votes"])

    got = sorted(rows.select("text").mapInArrow(vote, "votes binary").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())
    votes = np.array([np.unpackbits(np.frombuffer(r.votes, np.uint8))[:count] for r in got], dtype=float).reshape(-1, count)
    return votes, np.array([r.n for r in got], dtype=float)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of ``docs(doc_id, text)`` that aren't held out."""
    ws = Workspace(docs.sparkSession, "toxicity")
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id") != 1))
    seen = seen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = ws.save(docs.select("doc_id", "text").join(F.broadcast(seen), "doc_id").select("text", "toxic"), "sample")
    learned, dropped = learn_lexicons(rows)
    votes, counts = vote_table(rows, learned, dropped)
    ws.drop("")
    if not votes.any():
        return Model(learned, dropped, np.full(votes.shape[1], 3.0), -3.0)
    weights, bias = fit_classifier(votes, fit_label_model(votes, counts, least_ratios(votes.shape[1])).posterior(votes), counts)
    return Model(learned, dropped, weights, bias)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score as column ``name``."""
    ship(docs.sparkSession)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name.lower() != name.lower()], T.StructField(name, T.DoubleType())])
    own = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, weights = Voters(model.learned, model.dropped), model.weights.tolist()
        for batch in batches:
            logit = np.array([sum(weights[i] for i in sorted(voters.votes(t.as_py()))) for t in batch.column(text)], dtype=float) + model.bias
            yield pa.record_batch([*[batch.column(c) for c in own], pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))), pa.float64())], names=[*own, name])

    return docs.select(*[f"`{c}`" for c in own]).mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    model = train(docs, labels)
    found = scored(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(fold("doc_id") == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't call toxic."""
    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return scored(docs, train(docs, labels), name=name).where(F.col(name) < THRESHOLD).drop(name)
