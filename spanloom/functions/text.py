"""Conversation and prompt texts. Column functions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

#: Patterns of the raw records.
BOX_REQUEST = r"(?is)\s*Please provide the bounding box coordinate.*"
NUMBER = r"[-+]?\d+(?:\.\d+)?"
PURE_BOX = r"^[\[\(]?\s*(?:[-+]?\d+(?:\.\d+)?\s*,\s*){3}[-+]?\d+(?:\.\d+)?\s*[\]\)]?$"


def strip(text: Column) -> Column:
    """Without outer white space of any kind; trim cuts blanks only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chat_role(role: Column) -> Column:
    """human and gpt as user and assistant; anything else as it is."""
    return F.when(role == "human", F.lit("user")).when(role == "gpt", F.lit("assistant")).otherwise(role)


def strict_role(role: Column) -> Column:
    """As chat_role; a role that is neither of the four known ones nor system raises."""
    known = chat_role(role)
    return F.when(known.isin("user", "assistant", "system"), known).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))))


def mark_media(text: Column, video: bool = False) -> Column:
    """Placeholders, with a newline on either side, as vision marks."""
    placeholder, mark = (config.VIDEO_PLACEHOLDER, config.VIDEO_MARK) if video else (config.IMAGE_PLACEHOLDER, config.IMAGE_MARK)
    return F.regexp_replace(text, rf"\n?{placeholder}\n?", mark.replace("$", r"\$"))


def untag_answer(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<answer> "), F.lit(config.ANSWER_PREFIX + " ")), F.lit(" </answer>"), F.lit(""))


def reflection_blocks(counts: Column) -> Column:
    """One block of markers for every count above 0, in order."""
    block = lambda n: F.concat(F.lit(config.REFLECTION_START), F.repeat(F.lit(config.REFLECTION_TOKEN), n.cast("int")), F.lit(config.REFLECTION_END))
    return F.array_join(F.transform(F.filter(counts, lambda n: n > 0), block), "")


def reflect(text: Column, counts: Column) -> Column:
    """An assistant text with its blocks before it: stripped if all counts are 0, left alone if there are none."""
    plain = untag_answer(text)
    blocks = reflection_blocks(counts)
    return F.when(F.length(blocks) > 0, F.concat(blocks, plain)).when(F.size(counts) > 0, strip(plain)).otherwise(plain)


def reflect_video(answer: Column, tokens: Column) -> Column:
    """An answer after one block of markers, if there are tokens at all."""
    return F.concat(reflection_blocks(F.array(tokens)), answer)


def without_box_request(text: Column) -> Column:
    return F.regexp_replace(text, BOX_REQUEST, "")


def is_box(text: Column) -> Column:
    """Whether a text, outer white space aside, is nothing but four numbers."""
    return strip(text).rlike(PURE_BOX)


def box_numbers(text: Column) -> Column:
    """The first four numbers of a text, clamped to [0, 1]."""
    found = F.slice(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), 1, 4)
    return F.transform(found, lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))


def with_placeholder(question: Column) -> Column:
    return F.when(F.contains(question, F.lit(config.IMAGE_PLACEHOLDER)), question).otherwise(F.concat(F.lit(config.IMAGE_PLACEHOLDER + "\n"), question))


def wrap_answer(answer: Column) -> Column:
    return F.concat(F.lit("\n<answer> "), answer, F.lit(" </answer>"))


def lettered(choices: Column) -> Column:
    """Choices as lines "A. text"; letters end at Z."""
    return F.array_join(F.transform(F.slice(choices, 1, 26), lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c, F.lit("\n"))), "")


def lettered_prompt(question: Column, choices: Column) -> Column:
    return F.concat(question, F.lit("\nOptions:\n"), lettered(choices))


def instructed_prompt(question: Column, choices: Column) -> Column:
    return F.concat(question, F.lit("\n"), lettered(choices), F.lit(config.OPTION_SENTENCE))


def four_option_prompt(question: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Question and four options in brackets; null if one of them is."""
    return F.concat(question, F.lit("\nOptions:\n(A)"), a, F.lit("\n(B)"), b, F.lit("\n(C)"), c, F.lit("\n(D)"), d)


def task_prompt(kind: str, text: Column) -> Column:
    """The prompt of one benchmark kind; an unknown kind is refused."""
    if kind == "vstar":
        return F.replace(text, F.lit(config.OPTION_SENTENCE), F.lit(config.LETTER_INSTRUCTION))
    if kind in ("hrbench", "blink"):
        return F.concat(text, F.lit(config.LETTER_INSTRUCTION))
    raise ValueError(f"no such kind of benchmark: {kind!r}")


def user_message(images: Column, question: Column, min_pixels: int | None = None, max_pixels: int | None = None) -> Column:
    """A chat message of typed parts: the images with their pixel limits, then the text."""
    low, high = (F.lit(x).cast("bigint") for x in (min_pixels, max_pixels))
    part = lambda kind, ref, text, lo, hi: F.struct(F.lit(kind).alias("type"), ref.alias("ref"), text.alias("text"), lo.alias("min_pixels"), hi.alias("max_pixels"))
    none, no_limit = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    parts = F.concat(F.transform(images, lambda x: part("image", x, none, low, high)), F.array(part("text", none, question, no_limit, no_limit)))
    return F.struct(F.lit("user").alias("role"), parts.alias("content"))


def system_turn() -> Column:
    """The system turn that begins every chat."""
    return chat_text(F.lit("system"), F.lit(config.SYSTEM_MESSAGE))


def chat_text(role: Column, content: Column) -> Column:
    """One turn of the chat template."""
    return F.concat(F.lit(config.TURN_START), role, F.lit("\n"), content, F.lit(config.TURN_END + "\n"))


def url_video_id(url: Column, fallback: Column) -> Column:
    """What follows the last watch?v= of a URL; the fallback where there is no URL."""
    return F.coalesce(F.element_at(F.split(url, r"watch\?v="), -1), fallback)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def in_folder(path: Column, folder: Column) -> Column:
    """A path under its folder, unless it is absolute, an address, or there is no folder."""
    whole = F.startswith(path, F.lit("/")) | F.startswith(path, F.lit("http"))
    return F.when(whole | folder.isNull() | (folder == ""), path).otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), path))


def stem(name: Column) -> Column:
    """A file name without its last ending; a leading dot begins none."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def composite_id(*parts: Column) -> Column:
    """Parts joined by _; null if one of them is."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("_"), p.cast("string"))
    return joined


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("1", "true", "yes", "y", "t")


def run_name(path: Column) -> Column:
    """The last segment of a checkpoint's path."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def step_file(steps: Column) -> Column:
    return F.format_string("steps%03d", steps)
