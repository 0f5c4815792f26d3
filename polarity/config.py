"""Settings of a run (replaces the reference's key=value settings file)."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that must equal the reference for the same results.
CYRILLIC_WORD = "[а-яА-ЯёЁ]+"   # default word pattern of the cleaner
NGRAM_SIZE = 3                   # n-gram size
NUMBER_OF_CLASSES = 5            # label classes (-2..2)
SVM_C = 1000.0                   # C of the C-SVC
SVM_EPS = 1e-3                   # stopping tolerance
SCORING_BATCH = 100              # texts buffered before a scoring run
STAMP_FORMAT = "dd.MM.yy-HH:mm:ss"  # run stamp, %d.%m.%y-%H:%M:%S

# Word patterns used with the test tables (they hold Latin script only).
LETTER_WORD = r"\p{L}+"
ACCENTED_WORD = "[à-öø-ÿÀ-ÖØ-ß]+"


@dataclass(frozen=True)
class Settings:
    pattern: str = CYRILLIC_WORD
    ngram_size: int = NGRAM_SIZE
    n_classes: int = NUMBER_OF_CLASSES
    use_tf: bool = True
    norm: str = "scale"          # "scale": reference formula idf*tf*d; "l2": divide by d
    texts_limit: int = -1        # -1 = all rows
    svm_type: str = "C_SVC"
    kernel: str = "LINEAR"       # LINEAR | RBF | POLY
    C: float = SVM_C
    eps: float = SVM_EPS
    gamma: float = 0.0           # 0 -> 1 / number of features
    degree: int = 3
    kernel_dim: int = 256        # size of the random feature map for RBF / POLY
    seed: int = 7
    max_iter: int = 10_000       # bound on solver steps; a fit that reaches it warns
    batch_size: int = SCORING_BATCH
    multiclass: str = "ovr"      # ovr: one model per class; ovo: one per pair, votes (libsvm's rule)

    def __post_init__(self):
        if self.norm not in ("scale", "l2"):
            raise ValueError(f"norm must be 'scale' or 'l2', got {self.norm!r}")
        if self.kernel not in ("LINEAR", "RBF", "POLY"):
            raise ValueError(f"unsupported kernel {self.kernel!r}")
        if self.svm_type != "C_SVC":
            raise ValueError("only C_SVC is supported")
        if self.ngram_size < 1:
            raise ValueError("ngram_size must be >= 1")
        if self.multiclass not in ("ovr", "ovo"):
            raise ValueError("multiclass must be 'ovr' or 'ovo'")
        if self.n_classes not in (2, 5):
            raise ValueError("n_classes must be 2 or 5")
