"""Flag broken pairs of prompt and reply: empty, truncated, refusal, copy, wrong_language.

Replies are aligned with their prompts (shingle containment, then longest
common subsequence) to find copies, and with refusal templates (Smith-Waterman
over slots) to find refusals. Whether a reply stops before its end is decided
by how often its last words end a sentence anywhere in the corpus, be there a
full stop behind them or not, and a last word that stands nowhere else, where
the words before it are followed by other ones, is a cut one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, keyed, maybe_broadcast, spread
from .endings import count_endings, find_tokens, folded, longest_rivals, tail_codes
from .languages import ASKED, same_language, unquoted
from .refusals import is_refusal_text

#: Roles, markers, stand-ins for nothing, labels before a repeated question.
ASKING = ("human", "user")
REPLYING = ("gpt", "assistant")
MARKER = re.compile(r"</?(?:answer|image|video|bor|vr|eor)>|<\|[a-z_]{1,20}\|>", re.IGNORECASE)
STAND_INS = frozenset("n a|na|nan|null|nil|nul|undefined|blank|empty|no answer|no response|no reply|not available|not applicable|missing|tbd|todo|unknown value|keine antwort|leer|sans réponse|vide|sin respuesta|vacío|无|空|空白|无答案|没有答案".split("|"))
LEAD_IN = re.compile(r"\s*the answer is\s*:?\s*(?=\W|$)|\s*the answer is\s*:\s*", re.IGNORECASE)
LABEL = re.compile(r"\A\s*(?:q|question|frage|pregunta|prompt|user|human|问题|问)\s*[:：]\s*", re.IGNORECASE)

#: Words that end no sentence, by which a rare ending is judged.
OPEN_WORDS = frozenset(
    "a an the and or but of to from in on at by for with as than that which who whose while when where because if then is are was were be been has have had its their his her this these very "
    "der die das den dem des ein eine einen einem einer und oder aber von vom zu zum zur im am ins mit auf für bei dass weil wenn während hinter unter neben ist sind war wird sehr ohne "
    "le la les un une des du de et ou mais que qui dont dans sur sous avec pour par au aux sans est sont ses sa son très près "
    "el los las una unos unas del y o pero con en para por sin al es son su sus muy cerca junto "
    "的 在 和 把 被 从 向 对 与 或 是 将 给 让 跟 于 并 而 但 及 里".split()
)
#: Parts of a text that copies a question: share of its shingles found in the prompt, share of the question's words it repeats.
CONTAINED = 0.8
REPEATED = 0.9
#: Share of a gram's occurrences under which ends make it no ending: of an unterminated reply, and of one that a full stop ends.
RARE_END = 0.01
RARE_STOP = 0.005
#: Ends and occurrences added to every gram, so that a few occurrences decide nothing.
PRIOR_ENDS, PRIOR_SEEN = 0.2, 2.0
#: A cut word hardly stands anywhere but last, a longer word beginning with it is seen so many times as often, and it hardly ever follows the word before it.
INNER_SHARE = 0.05
CUT_FACTOR = 4
FOLLOWING_SHARE = 0.05
BROADCAST_ROWS = 1_000_000
#: Turns of a conversation that are looked at together; a longer one is split among tasks.
BLOCK = 4096

_SENTENCE = re.compile(r"[.!?。！？]+")
_TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]]*\Z")
_DOTS = re.compile(r"(?:\.\s*){2,}\Z|…+\Z|(?<=。)\s*\.+\Z")
_DANGLING = re.compile(r"[,;:、，；：(\[“„«\-–—/&]\Z")
_NOISE = re.compile(r"[^\w.,:;?!。？！，、；：\"'”’»)\]…\-–—(\[“„«/&%]+\Z")
_LIST_END = re.compile(r"(?:\A|\s)(\d{1,2})[.)]\s*\Z")
_ASCII_INVISIBLE = re.compile(r"[^A-Za-z0-9$+<=>|~]+")
_ENGLISH = " the "
_QUOTED_OR_WIDE = re.compile(r"[^\x00-\x7f]|\"")
_APOSTROPHE = re.compile(r"['’ʼ]")


def tokens(text: str) -> list[str]:
    plain = text.replace("'", " ") if text.isascii() else _APOSTROPHE.sub(" ", unicodedata.normalize("NFKC", text))
    return find_tokens(plain.lower())


def bare(reply: str) -> str:
    """A reply without markers and the words that lead in an answer."""
    text = (MARKER.sub(" ", reply) if "<" in reply else reply).strip()
    return LEAD_IN.sub("", text, count=1).strip() if text[:3].lower() == "the" else text


def without_request(prompt: str) -> str:
    """A prompt without markers and the request for a box; as it is if nothing else is in it."""
    text = MARKER.sub(" ", prompt) if "<" in prompt else prompt
    at = text.lower().find("please provide the bounding box")
    return (text[:at] if at >= 0 else text).strip() or prompt


def is_empty(text: str) -> bool:
    """Whether nothing but blanks, punctuation or a stand-in for nothing is left of a bare reply."""
    if len(text) > 20 and sum(map(str.isalnum, text[:60])) > 20:
        return False  # what stands for nothing is shorter
    if text.isascii():
        visible = _ASCII_INVISIBLE.sub("", text)
        return not visible or len(visible) <= 20 and visible not in ("None", "none") and (" ".join(tokens(text)) in STAND_INS or visible.lower() in STAND_INS)
    visible = "".join(c for c in text if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Sc", "Sm", "So"))
    if not visible or all(unicodedata.category(c) == "So" for c in visible):
        return not any(unicodedata.category(c) == "So" for c in visible)
    if visible in ("None", "none"):
        return False
    return len(visible) <= 20 and (" ".join(tokens(text)) in STAND_INS or visible.lower() in STAND_INS)


def _shingles(words: list[str], n: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(n)), strict=False))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def is_copy(prompt: str, text: str) -> bool:
    """Whether a bare reply is only the question, or its main sentence, again."""
    said = tokens(LABEL.sub("", text, count=1))
    if len(said) < 3:
        return False
    asked = tokens(prompt)
    known = set(asked)
    if sum(w in known for w in said) < CONTAINED * (len(said) - 2):
        return False
    n = 2 if len(said) < 12 else 3
    pool = set(_shingles(asked, n))
    own = _shingles(said, n)
    if sum(s in pool for s in own) < CONTAINED * len(own):
        return False
    sentences = [t for t in map(tokens, _SENTENCE.split(prompt)) if t]
    question = max([t for t in map(tokens, re.findall(r"[^.!?。！？]*[?？]", prompt)) if t] or sentences or [asked], key=len)
    return lcs(question, said) >= REPEATED * len(question) and (lcs(asked, said) >= 0.5 * len(asked) or len(question) >= 5)


def is_refusal(text: str) -> bool:
    """Whether a bare reply, quotations left out, holds a refusal."""
    return is_refusal_text(unquoted(text))


def is_foreign(prompt: str, text: str) -> bool:
    """Whether a bare reply is in another language than the prompt, which asks for none."""
    if text.isascii() and text.count(" ") < 3 and len(text.split()) < 4:
        return False  # too little of it to tell
    if _ENGLISH in text and _ENGLISH in prompt and not _QUOTED_OR_WIDE.search(text):
        return False  # the most frequent case, told without counting
    fold = unicodedata.normalize
    return same_language(fold("NFKC", unquoted(prompt)), fold("NFKC", unquoted(text))) is False and not ASKED.search(prompt)


def tail_of(text: str) -> tuple[str, list[str]] | None:
    """(state, last words of the last sentence, at most three) of a bare reply; None if its end is no matter of words.

    state "cut" stops within a list, a quotation or a clause; "open" must be
    judged by its words; "loose" is a phrase rather than a sentence, which only
    a word that ends nothing shows to be cut; "short" is an answer in a word or
    three, which only a cut word shows to be one; "stopped" has a full stop.
    """
    ended = folded(text).rstrip()
    if ended and not ended[-1].isalnum() and ended[-1] not in ".。":
        ended = _NOISE.sub("", ended).rstrip()
    dots = _DOTS.search(ended, max(0, len(ended.rstrip(".…。 \t\n")) - 1)) if ended[-1:] in (".", "…") else None
    if dots:
        ended = _NOISE.sub("", ended[: dots.start() + (1 if ended[dots.start()] == "。" else 0)]).strip()
        if ended.endswith((".", "。")) or dots[0].startswith((". .", ". …")) or re.match(r"\.\s+\.", dots[0]):
            return None
    item = _LIST_END.search(ended, max(0, len(ended) - 8)) if ended[-1:] in (".", ")") else None
    if item and re.search(rf"(?:\A|\s){int(item[1]) - 1}[.)]\s+\w", ended):
        return "cut", find_tokens(ended.lower())[-3:]
    if not ended:
        return None
    if any(ended.count(a) > ended.count(b) for a, b in ("[]", "()")) and re.fullmatch(r"[][()\d\s.,;eE+\-]*\d[\s.,;]*", ended):
        return "cut", find_tokens(ended)[-3:]  # a list of numbers left open
    stopped = ended[-1] in ".。"
    if not stopped and _TERMINAL.search(ended):
        return None
    sentence = _last_sentence(ended)
    last = find_tokens(sentence.lower())
    if not any(map(str.isalpha, "".join(last))):
        return None
    if stopped:
        return ("stopped", last[-3:]) if len(last) > 1 else None
    words = find_tokens(ended.lower())
    if _DANGLING.search(ended) and len(words) > 1:
        return "cut", words[-3:]
    quotes = ended.count('"') % 2 or ended.count("“") > ended.count("”") or ended.count("(") > ended.count(")")
    if quotes and len(words) > 3:
        return "cut", words[-3:]
    if ended[-1] in "\"'”’»)]":
        return None
    first = next(c for c in ended if c.isalpha())
    wide = re.match(r"[぀-ヿ㐀-鿿豈-﫿]", first)
    loose = len(words) < 8 if wide else first.islower()
    if loose and len(words) < 4:
        return ("short", last[-3:]) if len(last) > 1 else None
    return "loose" if loose or len(words) < 3 else "open", last[-3:]


def _last_sentence(text: str) -> str:
    """What follows the last sentence end of a text, one at its very end left out."""
    body = text.rstrip(".。 \t\n")
    return body[max(map(body.rfind, ".!?。！？")) + 1 :]


#: What a pair's words alone show: the defect, or the state and the codes of the last word, the one before it, the last two and the last three.
JUDGED = "tbl string, rec_id bigint, turn bigint, defect string, state string, g1 string, h1 bigint, hu bigint, h2 bigint, h3 bigint"
_JUDGED_ARROW = pa.schema([("tbl", pa.string()), ("rec_id", pa.int64()), ("turn", pa.int64()), ("defect", pa.string()), ("state", pa.string()), ("g1", pa.string()), *((h, pa.int64()) for h in ("h1", "hu", "h2", "h3"))])


def judge(prompt: str, reply: str | None) -> tuple[str | None, str | None, list[str] | None]:
    """(defect, state, last words): the defect that the pair alone shows, or the tail to judge by the corpus."""
    text = bare(reply) if reply else ""
    if not text or is_empty(text):
        return "empty", None, None
    asked = without_request(prompt)
    if is_copy(asked, text):
        return "copy", None, None
    if is_refusal(text):
        return "refusal", None, None
    if is_foreign(asked, text):
        return "wrong_language", None, None
    tail = tail_of(text)
    if tail is None:
        return None, None, None
    return ("truncated" if tail[0] == "cut" else None), *tail


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        out: list[tuple] = []
        for tbl, rec, turn, prompt, reply in zip(*columns, strict=True):
            defect, state, tail = judge(prompt, reply)
            if defect:
                out.append((tbl, rec, turn, defect, None, None, None, None, None, None))
            elif state:
                out.append((tbl, rec, turn, None, state, tail[-1], *tail_codes(tail)))
        cells = list(zip(*out, strict=True)) or [()] * len(_JUDGED_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _JUDGED_ARROW, strict=True)], schema=_JUDGED_ARROW)


def _cut_tails(tails: DataFrame, replies: DataFrame) -> DataFrame:
    """(k): the keys of those tails (k, state, g1, h1, hu, h2, h3) that stop before a sentence's or a word's end."""
    wanted = tails.select(F.explode(F.array("h2", "h3")).alias("h")).where("h is not null").distinct()
    counts = checkpointed(count_endings(replies, bare, wanted))
    small = maybe_broadcast(counts.drop("word"), BROADCAST_ROWS)
    for x in ("1", "u", "2", "3"):
        side = small.select(F.col("h").alias(f"h{x}"), *(F.col(c).alias(f"{c}{x}") for c in ("n", "ends", "goes_on", "last")))
        tails = tails.join(side, f"h{x}", "left")
    tails = checkpointed(tails.fillna(0))
    rare = tails.where((F.length("g1") > 1) & F.col("h2").isNotNull() & (F.col("n1") - F.col("last1") <= INNER_SHARE * F.col("n1"))).select("g1").distinct()
    rivals = longest_rivals(counts.where("word is not null").select("word", "n"), rare)
    tails = tails.join(maybe_broadcast(checkpointed(rivals), BROADCAST_ROWS), "g1", "left")

    def no_end(x: str, share: float) -> Column:
        seen = F.col(f"ends{x}") + F.col(f"goes_on{x}")
        return (F.col(f"ends{x}") + PRIOR_ENDS) < share * (seen + PRIOR_SEEN)

    open_word = F.col("g1").isin(*sorted(OPEN_WORDS)) & (F.col("ends2") <= RARE_END * (F.col("ends2") + F.col("goes_on2")))
    cut = F.coalesce((F.col("longer") >= CUT_FACTOR * F.col("n1")) & (F.col("n2") <= FOLLOWING_SHARE * F.col("nu")), F.lit(False))
    state = F.col("state")
    unfinished = (
        cut
        | (state.isin("open", "loose") & open_word)
        | ((state == "open") & (no_end("1", RARE_END) | no_end("2", RARE_END) | no_end("3", RARE_END)))
        | ((state == "stopped") & (no_end("1", RARE_STOP) | no_end("2", RARE_STOP) | no_end("3", RARE_STOP)))
    )
    return tails.where(unfinished).select("k")


def broken_pairs(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """(tbl, rec_id, turn, defect): one row per defective pair of (tbl, rec_id, turn, prompt, reply).

    replies (a column reply) is the corpus whose sentences show what an ending
    looks like; it must hold at least the pairs' replies. Pairs whose prompt is
    null, blank or only markers are left out; a null reply is "empty". The
    first that holds of empty, copy, refusal, wrong_language, truncated is
    given. Rows must be unique by tbl, rec_id and turn; extra columns are
    ignored; empty tables give an empty result.
    """
    asked = F.regexp_replace("prompt", r"(?iU)</?(?:image|video)>|[\s\u200b-\u200d\u2060\ufeff]+", "")
    rows = spread(pairs.selectExpr("cast(tbl as string) tbl", "cast(rec_id as bigint) rec_id", "cast(turn as bigint) turn", "prompt", "reply").where(F.length(asked) > 0))
    first = rows.mapInArrow(_judge_batches, JUDGED).withColumn("k", F.when(F.col("state").isNotNull(), F.xxhash64("state", "h1", "h2", "h3")))
    first = checkpointed(first)
    tails = first.where("k is not null").select("k", "state", "g1", "h1", "hu", "h2", "h3").dropDuplicates(["k"])
    late = first.join(maybe_broadcast(checkpointed(_cut_tails(tails, replies)), BROADCAST_ROWS), "k").select("tbl", "rec_id", "turn", F.lit("truncated").alias("defect"))
    return first.where(F.col("defect").isNotNull()).select("tbl", "rec_id", "turn", "defect").unionByName(late)


def _latest(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Of rows delivered again the latest. The rows stay in the order of their keys, which windows over them use."""
    order = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in ("loaded_at", *values)))
    return df.select(*keys, "loaded_at", *values).withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*keys, *values)


def record_pairs(videos: DataFrame) -> DataFrame:
    """Question and answer of each rec_id; of a record delivered again, the latest delivery."""
    latest = _latest(keyed(videos, "rec_id"), ["rec_id"], "question", "answer")
    return latest.select(F.lit("video_records").alias("tbl"), "rec_id", F.lit(0).cast("bigint").alias("turn"), F.col("question").alias("prompt"), F.col("answer").alias("reply"))


def conversation_pairs(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each asking turn with the replying turn numbered next; a prompt of markers alone takes the question before it.

    A conversation is looked at in blocks of turns, so a very long one is no
    single task; what a block needs of its neighbours comes from one row each,
    and only conversations of several blocks have such rows.
    """
    parted = turns.withColumn("block", F.floor(F.col("turn") / block))
    asks = F.col("role").isin(*ASKING)
    marked = F.regexp_replace("text", r"(?iU)<image>|\s+", "")
    question = F.when(asks & (F.length(marked) > 0), F.col("text"))

    def latest(df: DataFrame) -> DataFrame:
        return _latest(keyed(df, "conv_id", "block"), ["conv_id", "block", "turn"], "role", "text")

    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    follow = F.struct(F.lead("turn").over(inside).alias("turn"), F.lead("role").over(inside).alias("role"), F.lead("text").over(inside).alias("text"))
    rows = latest(parted).select("conv_id", "turn", "block", "role", "text", F.last(question, ignorenulls=True).over(inside).alias("asked"), follow.alias("next"))

    long = turns.where(F.col("turn") >= block - 1).select("conv_id").distinct()
    of_long = latest(parted.join(maybe_broadcast(long, BROADCAST_ROWS), "conv_id", "left_semi"))
    edges = of_long.groupBy("conv_id", "block").agg(F.max_by(question, F.when(question.isNotNull(), F.col("turn"))).alias("last_asked"), F.min_by(F.struct("turn", "role", "text"), "turn").alias("head"))
    by_conv = Window.partitionBy("conv_id").orderBy("block")
    edges = edges.select("conv_id", "block", F.last("last_asked", ignorenulls=True).over(by_conv.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("head").over(by_conv).alias("after"))
    full = rows.where(asks).join(maybe_broadcast(edges, BROADCAST_ROWS), ["conv_id", "block"], "left")
    following = F.when(F.col("next.turn").isNotNull(), F.col("next")).otherwise(F.col("after"))
    replied = (following["turn"] == F.col("turn") + 1) & following["role"].isin(*REPLYING)
    return full.select(F.lit("conversations").alias("tbl"), F.col("conv_id").alias("rec_id"), "turn", F.coalesce("asked", "before").alias("prompt"), F.when(replied, following["text"]).alias("reply"))


def all_replies(videos: DataFrame, turns: DataFrame) -> DataFrame:
    return videos.select(F.col("answer").alias("reply")).unionByName(turns.where(F.col("role").isin(*REPLYING)).select(F.col("text").alias("reply")))
