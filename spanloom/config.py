"""Constants and presets, fixed values of the data formats handled here."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Marker strings, labels, sentences.
IGNORE_INDEX = -100
IMAGE_PLACEHOLDER = "<image>"
VIDEO_PLACEHOLDER = "<video>"
IMAGE_MARK = "<|vision_start|><|image_pad|><|vision_end|>"
VIDEO_MARK = "<|vision_start|><|video_pad|><|vision_end|>"
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
REFLECTION_START = "<BOR>"
REFLECTION_END = "<EOR>"
REFLECTION_TOKEN = "<VR>"
SYSTEM_MESSAGE = "You are a helpful assistant."
LETTER_INSTRUCTION = "\nOutput the letter of the correct answer only."
OPTION_SENTENCE = "Answer with the option's letter from the given choices directly."
ANSWER_PREFIX = "The answer is:"
PATCH_FACTOR = 28
MERGE = 2
MAX_ASPECT = 200
FRAME_STEP = 2
LEAST_FRAMES = 4
FRAME_TOKENS = 768

#: Names of benchmark files and folders.
FOUR_OPTION_FILE = "hr_bench_{}.parquet"
URL_KEYED_FILE = "test-00000-of-00001.parquet"
TASK_FOLDER = "json"
ASSETS_FOLDER = "assets"

#: Endings of files that are no videos.
NON_VIDEO_ENDINGS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff", ".tif", ".gif", ".json", ".txt", ".md", ".csv", ".tsv", ".srt", ".vtt", ".ass", ".npy", ".npz", ".pt", ".pth", ".pkl", ".bin", ".parquet", ".zip", ".tar", ".gz", ".log", ".yaml", ".yml", ".html", ".lock")


@dataclass(frozen=True)
class ImagePreset:
    """Image tuning budgets."""

    min_pixels: int = 128 * 784
    max_pixels: int = 4096 * 784
    crop_min_pixels: int = 16 * 784
    crop_max_pixels: int = 128 * 784
    area_threshold: float = 1.0
    max_tokens: int = 16384
    long_threshold: int = 4096
    max_instances: int = 4
    max_buffers: int = 100
    align_weight: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class VideoPreset:
    """Video tuning budgets."""

    min_pixels: int = 128 * 784
    max_pixels: int = 256 * 784
    crop_min_pixels: int = 16 * 784
    crop_max_pixels: int = 64 * 784
    fps: float = 1.0
    max_frames: int = 256
    clue_frames: int = 3
    max_tokens: int = 20000
    align_weight: float = 0.1


@dataclass(frozen=True)
class EvalTask:
    """A benchmark: its kind and its frame and pixel budget."""

    kind: str
    fps: float = 1.0
    max_frames: int = 256
    total_pixels: int = 16384 * 784
    min_pixels: int = 128 * 784
    max_pixels: int = 460800
    split: str | None = None


#: Benchmarks by name.
TASKS = {
    "vstar": EvalTask("image"),
    "hrbench4k": EvalTask("image", min_pixels=3211264, max_pixels=12845056, split="4k"),
    "hrbench8k": EvalTask("image", min_pixels=3211264, max_pixels=12845056, split="8k"),
    "blink": EvalTask("image", split="val"),
    "videomme": EvalTask("video", 2.0, 512, 20000 * 784, 50176, 460800),
    "mlvu": EvalTask("video", 2.0, 512, 20000 * 784, 50176, 460800),
    "mvbench": EvalTask("video", 2.0, 256, 16384 * 784, 12544, 602112),
}


def task_options(name: str, **given: object) -> EvalTask:
    """The defaults of a task with what is given (and isn't None) in their place; an unknown name or option is refused."""
    if name not in TASKS:
        raise ValueError(f"no such task: {name!r}")
    return replace(TASKS[name], **{k: v for k, v in given.items() if v is not None})
