"""Names, schemas and fixed tables shared by all jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# The seven canonical scores, in their canonical order.
SCORES = (
    "clip_score",
    "aesthetic_score",
    "image_reward_score",
    "pick_a_score_score",
    "hpsv2_score",
    "vqa_score",
    "sciscore_score",
)
SYNTHETIC = tuple(f"synthetic_{name}" for name in SCORES)

# Stored score = (raw + offset) / divisor.
AFFINE = {
    "clip_score": (0.0, 100.0),
    "aesthetic_score": (0.0, 10.0),
    "image_reward_score": (2.0, 4.0),
    "pick_a_score_score": (0.0, 100.0),
    "hpsv2_score": (0.0, 1.0),
    "vqa_score": (0.0, 1.0),
    "sciscore_score": (0.0, 100.0),
}

# Mean and deviation that standardise the raw image-reward head.
IMAGE_REWARD_MEAN = 0.16717362830052426
IMAGE_REWARD_STD = 1.0333394966054072

# Caption that the synthetic twin of each score is computed on
# ("copy" = the original value is reused).
SYNTHETIC_CAPTION = {
    "clip_score": "long",
    "aesthetic_score": "copy",
    "image_reward_score": "short",
    "pick_a_score_score": "short",
    "hpsv2_score": "short",
    "vqa_score": "long",
    "sciscore_score": "short",
}

# Scorers of the evaluation tables, in reporting order.
EVAL_SCORERS = ("aesthetic", "pick_score", "image_reward", "hpsv2", "clip_jina", "clip_openai")

# Extensions that count as an image.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")

# Colour palette of the detection verdicts, in reporting order.
COLORS = (
    "red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white",
)

# Latent statistics per channel.
LATENT_SCALE = 0.13025
LATENT_CHANNEL_SCALE = (7.8518, 5.8465, 6.8716, 5.3140)
LATENT_CHANNEL_BIAS = (-0.3480, 0.3754, 0.0419, 2.4331)

MEMBERS = T.StructType(
    [
        T.StructField("shard", T.StringType()),
        T.StructField("member_idx", T.LongType()),
        T.StructField("member", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)

SAMPLE_JSON = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("caption", T.StringType()),
        T.StructField("synthetic_caption", T.StringType()),
        T.StructField("short_synthetic_caption", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in SCORES + SYNTHETIC],
    ]
)

_SHARD = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("nsamples", T.LongType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("name", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("dataset", T.StringType()),
    ]
)
DESCRIPTOR = T.StructType(
    [
        T.StructField("wids_version", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("base", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("shardlist", T.ArrayType(_SHARD)),
        T.StructField(
            "datasets",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("weight", T.DoubleType()),
                        T.StructField("base", T.StringType()),
                        T.StructField("source_url", T.StringType()),
                        T.StructField("shardlist", T.ArrayType(_SHARD)),
                    ]
                )
            ),
        ),
    ]
)

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2", "score")])

# The detector's 80 class names; a class id is the place in this list.
DETECTOR_CLASSES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat",
    "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog",
    "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella",
    "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite",
    "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant",
    "bed", "dining table", "toilet", "tv", "laptop", "computer mouse", "tv remote",
    "computer keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator",
    "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)
