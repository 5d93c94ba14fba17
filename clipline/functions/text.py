"""Text tests and cleaners as column expressions. All patterns are Unicode aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openers, phrases and weights that decide the scores and the boundaries.
CONTINUATION_OPENERS = (
    "and", "but", "or", "so", "because", "which", "that", "who",
    "then", "also", "therefore", "however", "including", "like",
    "of", "in", "on", "at", "to", "for", "with",
)
HOOK_PHRASES = (
    "most people", "nobody", "secret", "mistake", "wrong", "stop ",
    "why ", "how ", "because", "realized", "changed", "important",
    "the problem", "the truth", "what happens", "you need", "if you",
    "never", "always", "actually", "counterintuitive",
)
WEAK_SEGMENT_OPENERS = ("so", "um", "uh", "anyway", "basically", "right", "now", "okay", "welcome", "today")
BOILERPLATE_PHRASES = ("subscribe", "like and subscribe", "welcome back", "in this video")
VISUAL_PHRASES = ("look at this", "as you can see", "this graph", "on screen")
LEADING_FILLERS = (
    "and", "but", "or", "so", "yeah", "um", "uh", "well", "okay", "right",
    "anyway", "basically", "like", "now",
)
INCOMPLETE_ENDS = (
    "and", "but", "or", "nor", "yet", "so", "because", "since", "although", "though",
    "while", "when", "which", "who", "whom", "that", "as", "than", "if",
    "the", "a", "an", "my", "your", "his", "her", "its", "our", "their", "whose",
    "this", "these", "those",
    "to", "of", "for", "with", "in", "into", "on", "at", "from", "by", "about", "like",
    "is", "was", "are", "were", "be", "been", "am", "do", "does", "did",
    "have", "has", "had", "will", "would", "can", "could", "should", "may", "might", "must",
    "very", "really", "such", "more", "less", "most", "least", "quite", "rather", "even",
    "um", "uh", "yeah", "well", "just", "kind", "sort", "okay", "right", "anyway", "basically", "now",
    "i", "im", "ill", "id", "ive", "its", "thats", "youre", "youll", "theyre", "theyll",
    "hes", "shes", "weve",
)

SPACES = r"(?U)\s+"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"


# all of Unicode's white space; trimming reads the ends of a text only, where a pattern is tried at every character
WHITE = "\t\n\x0b\x0c\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.trim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACES, " "))


def tokens(c: Column) -> Column:
    """White-space separated pieces of a text."""
    return F.filter(F.split(c, SPACES), lambda t: t != "")


def clean_word(c: Column) -> Column:
    """Lower-case word with everything but letters, digits and underscore removed."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")


def clean_tokens(c: Column) -> Column:
    return F.filter(F.transform(tokens(c), clean_word), lambda t: t != "")


def ends_sentence(c: Column) -> Column:
    return F.right(strip(c), F.lit(1)).isin(".", "!", "?")


def continues_thought(c: Column) -> Column:
    """Opens with a connective or a lower-case letter, so it leans on what came before."""
    bare = strip(c)
    first = F.lower(F.regexp_replace(F.get(F.split(bare, SPACES, 2), F.lit(0)), r"^[^A-Za-z0-9]+", ""))
    return (bare != "") & (first.isin(*CONTINUATION_OPENERS) | bare.rlike(r"^\p{Ll}"))


def words_with_any(c: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def reel_score(text: Column) -> Column:
    """How promising a segment opens a clip: length, questions, numbers, hook phrases, minus weak openers."""
    bare = strip(text)
    lower = F.lower(bare)
    flag = lambda test, weight: F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    score = flag(F.length(bare).between(45, 260), 1.5) + flag(bare.contains("?"), 1.2)
    score = score + flag(lower.rlike(r"(?U)\b\d+[%x]?\b"), 0.8)
    for phrase in HOOK_PHRASES:
        score = score + flag(lower.contains(phrase), 0.9)
    score = score - flag(lower.rlike(rf"(?U)^\s*({'|'.join(WEAK_SEGMENT_OPENERS)})\b"), 2.0)
    score = score - flag(words_with_any(lower, BOILERPLATE_PHRASES), 2.5)
    return score - flag(words_with_any(lower, VISUAL_PHRASES), 1.5)


def first_number(c: Column, default: float = 0.0) -> Column:
    """First signed decimal in a text, else ``default``."""
    return F.coalesce(F.regexp_extract(c.cast("string"), r"-?\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(default))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def phrase_side(phrase: Column, side: str) -> Column:
    """Start or end piece of a phrase that was shortened with an ellipsis."""
    parts = F.filter(F.transform(F.split(phrase, r"\.\.\.|…"), strip), lambda p: p != "")
    pick = F.get(parts, F.lit(0)) if side == "start" else F.element_at(parts, -1)
    return F.when(F.size(parts) > 0, pick).otherwise(strip(phrase))


def ordered_distinct(items: Column, key=lambda c: c) -> Column:
    """Array without repeats, first occurrence kept; ``key`` says what counts as equal."""
    empty = F.slice(items, 1, 0)
    return F.aggregate(
        items,
        empty,
        lambda acc, x: F.when(F.exists(acc, lambda a: key(a) == key(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def safe_title(c: Column, limit: int = 80) -> Column:
    """Text usable as a file name."""
    return F.substring(F.regexp_replace(strip(c), r'[\\/*?:"<>|]', ""), 1, limit)


# Words a plan should not open on, and tags that say nothing about a topic.
WEAK_PLAN_OPENERS = (
    "and", "but", "or", "so", "yet", "nor", "for",
    "because", "since", "although", "though", "even", "while", "whereas",
    "if", "unless", "until", "when", "whenever", "where", "wherever",
    "which", "that", "who", "whom", "whose", "after", "before",
    "however", "therefore", "thus", "hence", "consequently",
    "moreover", "furthermore", "additionally", "also", "besides",
    "meanwhile", "nevertheless", "nonetheless", "otherwise", "instead",
    "then", "next", "finally", "lastly",
    "namely", "specifically", "particularly", "especially", "including",
    "such", "like", "as", "with", "without", "by", "from",
    "of", "in", "on", "at", "to",
    "plus", "except", "rather", "indeed", "certainly", "actually",
    "basically", "essentially", "ultimately",
    "yeah", "yes", "hey", "well", "now", "right", "okay", "ok",
    "um", "uh", "hmm", "ah", "oh", "look", "listen", "alright",
    "anyway", "you", "know", "i", "mean", "just", "literally",
)
REFINED_WEAK_OPENERS = (
    "and", "but", "or", "so", "because", "which", "then", "also",
    "therefore", "however", "um", "uh", "yeah", "of", "like",
    "well", "okay", "right", "anyway", "basically",
)
SOFT_OPENERS = (
    "kind of", "sort of", "what that", "the reason i", "the reason that",
    "it was like", "this thing", "that's the thing", "very difficult to argue",
    "difficult to argue", "as i said", "like i said", "you know what",
)
DEFAULT_TAGS = (
    "#viral", "#trending", "#fyp", "#shorts", "#foryou", "#growth", "#inspiration", "#content", "#clip", "#bestvideo",
)
FILLER_TAGS = (
    "#viral #fyp #shorts #trending #foryou #foryoupage #explore #reels #youtubeshorts #viralvideo #motivation"
    " #mindset #trendingshorts #subscribe #podcast #podcastclips #viralshorts #shortsfeed #reelsviral #trend"
    " #explorepage #contentcreator #inspiration #selfimprovement #growth #wellness #health #healthtips #lifehacks"
    " #knowledge #learnontiktok #educational #facts #science #biohacking #longevity #wellbeing #mentalhealth"
    " #dailymotivation #success"
)


def clean_hashtag(c: Column) -> Column:
    """Letters, digits and underscore behind one ``#``; empty when nothing is left."""
    bare = F.regexp_replace(strip(c), r"[^A-Za-z0-9_#]", "")
    return F.when(bare == "", F.lit("")).when(bare.startswith("#"), bare).otherwise(F.concat(F.lit("#"), bare))


def clean_hashtags(items: Column) -> Column:
    return ordered_distinct(F.filter(F.transform(items, clean_hashtag), lambda t: t != ""), F.lower)
