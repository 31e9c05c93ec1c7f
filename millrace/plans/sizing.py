"""Sizes that follow from row counts: of the filter, of the two bucket levels; and which options go together."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: The most buckets of the first level and of the second, how many a pass scans, the slots of a bucket's table, and what a filter segment should not exceed.
FIRST_MOST, SECOND_MOST, SCAN_WIDTH, SLOTS, SEGMENT_BYTES = 2048, 4096, 256, 10007, 4 << 20

#: Buckets where nothing asks for more.
FIRST_DEFAULT, SECOND_DEFAULT = 128, 67

#: Rows that a second-level bucket should not exceed: four fifths of the slots.
BUCKET_ROWS = SLOTS * 8 // 10


def filter_size(rows: int, rate: float, bits: int | None = None, hashes: int | None = None) -> tuple[int, int]:
    """Bits and hashes of a filter of so many keys for a false-positive rate. Above a rate of 0.5 there are no hashes, and all rows pass."""
    if not 0 < rate <= 1:
        raise ValueError("the rate is above 0 and at most 1")
    exact = -rows * math.log(rate) / math.log(2) ** 2
    best = int(exact / rows * math.log(2)) if rows else 0
    return (int(exact) if bits is None else bits), (best if hashes is None else hashes)


def first_level(rows_of_slice: int, filter_bits: int, partitioned: bool, given: int | None = None) -> int:
    """Buckets of the first level: as given; or enough that a filter segment stays small and the second level can do its part, if the filter is partitioned; at most FIRST_MOST."""
    if given is not None:
        return min(given, FIRST_MOST)
    if not partitioned:
        return FIRST_DEFAULT
    by_segment = -(-(-(-filter_bits // 8)) // SEGMENT_BYTES)
    by_join = -(-rows_of_slice // ((SCAN_WIDTH - 1) * BUCKET_ROWS))
    return min(max(by_segment, by_join, 1), FIRST_MOST)


def second_level(rows_of_slice: int, first: int, partitioned: bool, given: int | None = None) -> int:
    """Buckets of the second level: as given; or the default, or the next odd number at which buckets are small enough. Too many are cut if the filter is partitioned, else an error."""
    if given is not None:
        return min(given, SECOND_MOST)
    if -(-rows_of_slice // (first * SECOND_DEFAULT)) <= BUCKET_ROWS:
        return SECOND_DEFAULT
    wanted = -(-rows_of_slice // (first * BUCKET_ROWS)) | 1
    if wanted <= SECOND_MOST:
        return wanted
    if partitioned:
        return SECOND_MOST - 1
    raise ValueError(f"{wanted} buckets of the second level; raise the first")


#: The ways to make and merge the filter that a mode number stands for.
MODES = {
    0: "no filter",
    1: "filter early, again before sending",
    2: "filter early",
    3: "filter late",
    4: "merge at one machine",
    5: "merge in a ring",
    6: "merge on the host",
    7: "merge in a fused ring",
    8: "merge by pulling",
    9: "built with the histogram, ring",
    10: "partitioned filter",
    13: "merge by a reduction",
    14: "partitioned filter, merged in chunks",
    15: "merge by gathering",
    16: "merge by the bytes' maxima",
}

#: The modes under which rows may be rebalanced, and R shuffled.
REBALANCED, SHUFFLED = (1, 2, 4, 5, 6, 7, 8, 9, 10, 13), (5, 10)


@dataclass(frozen=True)
class Options:
    """What a run can be told. Machines are slices here; modes differ in how Spark is told to filter, never in results."""

    mode: int = 0
    rate: float = 0.1
    bits: int | None = None
    hashes: int | None = None
    slices: int = 4
    chunks: int = 1
    skew: float = 0.0
    first: int | None = None
    second: int | None = None
    shuffle_r: bool = False
    replicate_ratio: float = -1.0
    answer_rows: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode} is none of {sorted(MODES)}")
        if self.chunks < 1 or self.slices < 1:
            raise ValueError("chunks and slices are at least 1")
        if self.shuffle_r and self.replicate_ratio >= 0:
            raise ValueError("R is shuffled or replicated, not both")
        if self.replicate_ratio >= 0 and self.mode in (1, 3):
            raise ValueError("R can't be replicated in modes 1 and 3")
        if self.replicate_ratio > 0 and not self.rebalances:
            raise ValueError("a ratio above 0 needs rebalancing, which counts the candidates")

    @property
    def effective(self) -> int:
        """The mode whose results a mode shares."""
        return {14: 10, 15: 13, 16: 13}.get(self.mode, self.mode)

    @property
    def partitioned(self) -> bool:
        return self.effective == 10

    @property
    def rebalances(self) -> bool:
        return self.skew > 0 and self.effective in REBALANCED and not self.shuffle_r

    def shuffles(self, first: int) -> bool:
        """Whether R is shuffled: the mode allows it and buckets can be dealt evenly."""
        return self.shuffle_r and self.effective in SHUFFLED and first % self.slices == 0
