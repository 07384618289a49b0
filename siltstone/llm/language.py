"""Language of short texts, by profiles of words and character runs that are fitted on labelled texts.

Every profile begins with a passage of the Universal Declaration of Human Rights, which is public and the same in all languages; a
bounded sample of labelled rows (text, lang) adds to it. The weight of a feature in a language is its log-likelihood there against that
over all languages, smoothed towards the latter; what no profile has seen decides nothing, however small a profile is.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import WORD

# Passages of the Declaration (articles 1 and 3, for some languages also 2 or 4).
PASSAGES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion, national or social origin, property, birth or other status. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat Anspruch auf die in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Überzeugung, nationaler oder sozialer Herkunft, Vermögen, Geburt oder sonstigem Stand. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel sind in allen ihren Formen verboten.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude; l'esclavage et la traite des esclaves sont interdits sous toutes leurs formes.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Toda persona tiene todos los derechos y libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre, la esclavitud y la trata de esclavos están prohibidas en todas sus formas.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. Nessun individuo potrà essere tenuto in stato di schiavitù o di servitù; la schiavitù e la tratta degli schiavi saranno proibite sotto qualsiasi forma.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura ou em servidão; a escravatura e o trato dos escravos, sob todas as formas, são proibidos.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. Niemand zal in slavernij of horigheid gehouden worden.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Var och en har rätt till liv, frihet och personlig säkerhet.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Enhver har ret til liv, frihed og personlig sikkerhed.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Kullakin yksilöllä on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każda osoba ma prawo do życia, wolności i bezpieczeństwa swej osoby.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každý má právo na život, svobodu a osobní bezpečnost.",
    "sk": "Všetci ľudia sa rodia slobodní a rovní v dôstojnosti aj právach. Sú obdarení rozumom a svedomím a majú sa k sebe správať v duchu bratstva. Každý má právo na život, slobodu a osobnú bezpečnosť.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Minden személynek joga van az élethez, a szabadsághoz és a személyi biztonsághoz.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Orice ființă umană are dreptul la viață, la libertate și la securitatea persoanei sale.",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. Svatko ima pravo na život, slobodu i osobnu sigurnost.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
}
# Languages by the script that they alone, or most of all, are written in.
SCRIPTS = {"CYRILLIC": "ru", "GREEK": "el", "CJK": "zh", "HIRAGANA": "ja", "KATAKANA": "ja", "HANGUL": "ko", "ARABIC": "ar", "HEBREW": "he", "DEVANAGARI": "hi", "THAI": "th"}
#: Labelled rows: at most so many of each language, of at most so many characters, of at most so many languages.
SAMPLE_ROWS, SAMPLE_LENGTH, SAMPLE_LANGUAGES = 100, 4000, 32
#: Features' worth of smoothing; log-likelihood by which a language must win, and by how much more for each word.
FILL, MARGIN, MARGIN_A_WORD = 300.0, 3.0, 0.05
#: Each letter is in several features; their sum counts that much less.
OVERLAP = 3.0
#: Words a worker remembers.
REMEMBERED = 200_000


def plain_words(text: str) -> list[str]:
    return WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold())


def grams(word: str) -> list[str]:
    """The word itself with its ends, its runs of three characters, and its letters beyond ASCII."""
    ended = f"^{word}$"
    out = [ended, *(ended[i : i + 3] for i in range(len(ended) - 2))]
    return out if word.isascii() else out + [ch for ch in word if ch > "\x7f"]


class Profiles:
    """languages and, for each feature, its weight in each of them."""

    def __init__(self, labelled: Iterable[tuple[str, str]] = ()):
        counts: dict[str, Counter[str]] = {}
        for lang, text in [*PASSAGES.items(), *labelled]:
            own = counts.setdefault(lang, Counter())
            for word in plain_words(text):
                if not word.isdecimal():
                    own.update(grams(word))
        self.languages = [lang for lang in sorted(counts) if lang not in SCRIPTS.values()]
        features = sorted({g for lang in self.languages for g in counts[lang]})
        table = np.array([[counts[lang][g] for lang in self.languages] for g in features], dtype=np.float64)
        total = table.sum(axis=0)
        # what all languages together expect of a feature fills up a small profile
        expected = (table / total).mean(axis=1, keepdims=True)
        weights = np.log((table + FILL * expected) / (total + FILL) / expected).astype(np.float32)
        self.weights = dict(zip(features, weights, strict=True))
        self.known: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def of_word(self, word: str) -> np.ndarray:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = np.zeros(len(self.languages), dtype=np.float32)
            for g in () if word.isdecimal() else grams(word):
                if g in self.weights:
                    got = got + self.weights[g]
            got = self.known[word] = got / np.float32(OVERLAP)
        return got

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        """(score of each language, number of words)."""
        got = plain_words(text)
        return sum(map(self.of_word, got), np.zeros(len(self.languages), dtype=np.float32)), len(got)

    def language(self, text: str, own: str | None = None) -> str | None:
        """The language of a text: by script, else the one that wins by the margin over own, or over all others without own; None where none does."""
        if not text.isascii():
            script = main_script(text)
            if script != "LATIN":
                return SCRIPTS.get(script) if script else None
        scores, n = self.scores(text)
        if n < 2:
            return None
        best = int(scores.argmax())
        rival = scores[self.languages.index(own)] if own in self.languages else np.partition(scores, -2)[-2] if own is None else 0.0
        return self.languages[best] if scores[best] - rival >= MARGIN + MARGIN_A_WORD * n or self.languages[best] == own else None


def main_script(text: str) -> str | None:
    """The script of more than half of the letters; None where there are fewer than eight letters or no such script."""
    letters = Counter(text)
    scripts: Counter[str] = Counter()
    for ch, n in letters.items():
        if ch.isalpha():
            scripts["LATIN" if ch < "ɐ" else unicodedata.name(ch, "?").split(" ")[0]] += n
    if scripts.total() < 8:
        return None
    script, n = scripts.most_common(1)[0]
    return script if n * 2 > scripts.total() else None


def labelled_sample(df: DataFrame, text: str, lang: str) -> list[tuple[str, str]]:
    """(language, text) of a bounded sample of the rows with a language: a label's first letters in lower case name it. A language with fewer
    than ten rows is left out. Which rows are taken depends on their texts' hashes only."""
    code = F.regexp_extract(F.lower(F.trim(F.col(f"`{lang}`"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    body = F.col(f"`{text}`")
    # the share of a hash in all that there can be
    place = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    rows = df.select(code.alias("lang"), body.alias("text"), F.xxhash64(body).alias("h")).where((F.col("lang") != "") & ~F.col("lang").isin("und", "mul", "zxx") & F.char_length("text").between(20, SAMPLE_LENGTH))
    counts = [r for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LANGUAGES).collect() if r["count"] >= 10]
    if not counts:
        return []
    wanted = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 2 * SAMPLE_ROWS / r["count"]))) for r in counts), F.lit(0.0))
    held: dict[str, list[str]] = {}
    # each text once: copies of one must not make up a profile
    for r in rows.where(place < wanted).distinct().orderBy("h", "text").limit(4 * SAMPLE_ROWS * len(counts)).collect():
        held.setdefault(r["lang"], []).append(r["text"])
    return [(lang, t) for lang, texts in sorted(held.items()) for t in texts[:SAMPLE_ROWS]]
