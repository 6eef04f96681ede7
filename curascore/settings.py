"""Fixed values. Results depend on these, so they are stated here as they are."""

from __future__ import annotations

# --- fixed values: curation targets per split and the margins of the balance rule ---
SPLIT_TARGETS = {"train": 370, "test": 46, "validation": 46}
UNDER_MARGIN = 10
OVER_MARGIN = 20
REVIEW_MARGIN = 5
CURATION_SEED = 42
EVALUATION_SEED = 3407

# --- fixed values: class list, in its published (unsorted) order ---
CLASS_LIST = {
    "Apple": ["black_rot", "cedar_apple_rust", "fels", "healthy", "powdery_mildew", "rust", "scab"],
    "Bell Pepper": ["bacterial_spot", "healthy", "leaf_spot"],
    "Blueberry": ["healthy"],
    "Cherry": ["powdery_mildew", "healthy"],
    "Corn": ["common_rust", "gray_leaf_spot", "leaf_blight", "healthy", "nlb", "phaeosphaeria_leaf_spot"],
    "Grape": ["black_measles", "black_rot", "healthy", "leaf_blight"],
    "Olive": ["bird_eye_fungus", "healthy", "rust_mite"],
    "Orange": ["huanglongbing"],
    "Peach": ["bacterial_spot", "healthy"],
    "Potato": ["late_blight", "healthy", "early_blight"],
    "Raspberry": ["healthy"],
    "Rice": ["bacterial_leaf_blight", "bacterial_leaf_streak", "bacterial_panicle_blight", "brown_spot", "dead_heart",
             "downy_mildew", "healthy", "hispa", "leaf_blast", "leaf_scald", "nbls", "neck_blast", "tungro"],
    "Soybean": ["healthy"],
    "Squash": ["powdery_mildew"],
    "Strawberry": ["angular_leaf_spot", "blossom_blight", "gray_mold", "healthy", "leaf_scorch", "leaf_spot",
                   "powdery_mildew"],
    "Tomato": ["bacterial_spot", "late_blight", "healthy", "early_blight", "leaf_mold", "leaf_spot", "mosaic_virus",
               "spider_mites", "target_spot", "yellow_leaf"],
}

# --- fixed values: failure class ---
FALSE_PARSE = "false_parse"
FALSE_PARSE_ID = 65

# --- fixed values: views ---
MAIN, LAB, FIELD = "main", "lab", "field"
VIEWS = (MAIN, LAB, FIELD)

# --- fixed values: prompt templates ---
DISEASED_TEMPLATES = [
    "a photo of a {crop} leaf with {disease}",
    "an image of a {crop} leaf affected by {disease}",
    "a close-up photo of a {crop} leaf showing {disease}",
]
HEALTHY_TEMPLATES = [
    "a photo of a healthy {crop} leaf",
    "an image of a healthy {crop} leaf",
    "a close-up photo of a healthy {crop} leaf",
]

# --- fixed values: conversation texts ---
TRAIN_SYSTEM = (
    "You are an expert pathologist and need to identify the crop and disease present in an image. "
    "If it is a healthy crop, classify it as healthy"
)
QUESTION = "Identify the crop and disease in the image."
PURE_INSTRUCTION = (
    "You are an expert plant pathologist. Identify the crop and the disease present in the image provided. "
    "Respond in the following format:\nClass: [crop]\nDisease: [disease]\n"
)
CONTEXT_INSTRUCTION = (
    "You are an expert plant pathologist. You have a list of crop-disease pairs and need to identify the "
    "crop-disease present in the image provided, by selecting a crop-disease pair from the list. "
    "Here is the list:\n{labels}\nRespond with only the selected crop-disease pair from the list and nothing else."
)
CHOICE_INSTRUCTION = (
    "You are an expert plant pathologist. The image shows a plant with a disease.\n"
    "Which of the following is the correct diagnosis?\n{options}\n"
    "Respond with only the letter corresponding to the correct option."
)
CHOICE_KEYS = ["A", "B", "C", "D"]

# --- fixed values: experiment grid, batch size outer and learning rate inner ---
GRID_BATCH_SIZES = [16, 32, 64]
GRID_LEARNING_RATES = [1e-4, 5e-4, 2e-4]
MODEL_NAMES = {"resnet50": "ResNet50"}
OTHER_MODEL_NAME = "ConvNeXt-Tiny"

# --- fixed values: tensors and token ids ---
CHANNEL_MEAN = [0.485, 0.456, 0.406]
CHANNEL_STD = [0.229, 0.224, 0.225]
IGNORE_ID = -100
MAX_TRAIN_LENGTH = 256
NORM_FLOOR = 1e-12
TOP_K = 5
PARSE_SAMPLE_ROWS = 100

# --- fixed values: head metadata ---
HEAD_TYPE = "linear"
HEAD_NORMALIZATION = "l2_normalized_image_features"
HEAD_NOTE = "Backbone frozen; head trained via linear probing"
PROBE_LEARNING_RATES = [1e-3, 3e-3, 1e-2]


def class_pairs() -> list[tuple[str, str]]:
    """(crop, disease) pairs in published order."""
    return [(crop, disease) for crop, diseases in CLASS_LIST.items() for disease in diseases]
