"""Frame geometry: convolution arithmetic and frame grids, on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Conv:
    kernel: int
    stride: int = 1
    padding: int = 0
    dilation: int = 1

    def frames(self, n: int) -> int:
        return 1 + (n + 2 * self.padding - self.dilation * (self.kernel - 1) - 1) // self.stride


def num_frames(samples: int, layers: Sequence[Conv]) -> int:
    for layer in layers:
        samples = layer.frames(samples)
    return samples


def receptive_size(layers: Sequence[Conv], frames: int = 1) -> int:
    """Samples that so many output frames see."""
    for layer in reversed(layers):
        frames = 1 + (frames - 1) * layer.stride + layer.dilation * (layer.kernel - 1)
    return frames


def receptive_step(layers: Sequence[Conv]) -> int:
    step = 1
    for layer in layers:
        step *= layer.stride
    return step


def receptive_centre(layers: Sequence[Conv], frame: int = 0) -> float:
    centre: float = frame
    for layer in reversed(layers):
        centre = layer.stride * centre + (layer.dilation * (layer.kernel - 1) / 2 - layer.padding)
    return centre


@dataclass(frozen=True)
class Grid:
    """Frame i covers [start + i step, start + i step + duration]."""

    start: float
    duration: float
    step: float

    def middle(self, i: float) -> float:
        return self.start + i * self.step + self.duration / 2

    def closest(self, t: float) -> int:
        return round((t - self.start - self.duration / 2) / self.step)


def receptive_field(layers: Sequence[Conv], rate: int) -> Grid:
    size, step = receptive_size(layers), receptive_step(layers)
    return Grid((receptive_centre(layers) - (size - 1) / 2) / rate, size / rate, step / rate)
