"""Capture sinks: a sensor takes a plan of frames and writes what it records of them; sensors are plugins by name."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENSORS: dict[str, type] = {}


@dataclass
class CaptureConfig:
    """What to record. The defaults."""

    video_mode: bool = False
    rgb_mode: bool = False
    depth_mode: bool = False
    camera_height: float = 1.5
    image_width: int = 1280
    image_height: int = 720
    camera_fov: float = 87.0
    video_fps: int = 30
    video_step: float = 0.05
    max_capture_paths: int = 0  # 0: all
    seed: int = 42


def sensor(name: str):
    """Registers a sensor class under a name."""

    def add(cls: type) -> type:
        SENSORS[name] = cls
        return cls

    return add


class Sensor(ABC):
    def __init__(self, config: CaptureConfig):
        self.config = config

    @abstractmethod
    def collect(self, plan: DataFrame, folder: str) -> None:
        """Writes what is recorded of plan (path_id, frame and a pose) under folder; earlier output is overwritten."""


@sensor("camera")
class Camera(Sensor):
    """File names and camera settings of every frame in each wanted mode; pixels need a renderer and are not made here."""

    def modes(self) -> list[str]:
        c = self.config
        return [name for name, on in (("video", c.video_mode), ("rgb", c.rgb_mode), ("depth", c.depth_mode)) if on]

    def frames(self, plan: DataFrame) -> DataFrame:
        c = self.config
        suffix = F.when(F.col("mode") == "depth", ".npy").otherwise(".png")
        each = plan.withColumn("mode", F.explode(F.array(*(F.lit(m) for m in self.modes())).cast("array<string>")))
        return each.withColumn("file", F.concat("mode", F.lit("_"), "frame", suffix)).withColumns({"width": F.lit(c.image_width), "height": F.lit(c.image_height), "fov": F.lit(c.camera_fov)})

    def collect(self, plan: DataFrame, folder: str) -> None:
        self.frames(plan).write.mode("overwrite").partitionBy("mode").json(folder)


def chosen_paths(plan: DataFrame, config: CaptureConfig) -> DataFrame:
    """The plan of a seeded choice of paths, or of all."""
    if config.max_capture_paths <= 0:
        return plan
    some = plan.select("path_id").distinct().orderBy(F.xxhash64("path_id", F.lit(config.seed)), "path_id").limit(config.max_capture_paths)
    return plan.join(F.broadcast(some), "path_id", "left_semi")


def capture(plan: DataFrame, folder: str, config: CaptureConfig, names: tuple[str, ...] = ("camera",)) -> None:
    """Every named sensor over the chosen paths, each in a folder of its own."""
    own = chosen_paths(plan, config)
    for name in names:
        SENSORS[name](config).collect(own, f"{folder}/{name}")
