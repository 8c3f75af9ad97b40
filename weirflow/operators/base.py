"""What an action is: a validated model that maps a frame to a frame, lazily."""

from __future__ import annotations

from typing import Any, ClassVar

from pydantic import BaseModel, ConfigDict, ValidationError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..errors import RegistryError, StateError, TransformError
from ..functions.pipe import is_pipe
from ..registry import TRANSFORMS


class Transform(BaseModel):
    """Base of all actions. Unknown parameters are errors."""

    model_config = ConfigDict(extra="forbid", populate_by_name=True, arbitrary_types_allowed=True)
    #: element, set or collection
    tier: ClassVar[str] = "element"
    supports_quarantine: ClassVar[bool] = False
    #: the result depends on the order of rows, unless ``ordered_by`` says otherwise
    order_sensitive: ClassVar[bool] = False

    @classmethod
    def from_block(cls, block: Any) -> Transform:
        return cls.model_validate(block if isinstance(block, dict) else {"columns": block})

    def needs_order(self) -> bool:
        return self.order_sensitive

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        raise NotImplementedError

    def apply_safe(self, df: DataFrame, ctx: Any = None) -> tuple[DataFrame, DataFrame]:
        raise TransformError("this action can't quarantine rows")

    def verify(self, df: DataFrame, ctx: Any = None) -> None:
        """Raises now what would otherwise be raised when data is read."""

    def run(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        """``apply``, with Spark's analysis errors as the package's own."""
        try:
            out = self.apply(df, ctx)
            out.schema  # noqa: B018  plans are analysed here, not at the action
            return out
        except AnalysisException as e:
            raise TransformError(str(e).splitlines()[0]) from e


class ColumnMap(Transform):
    """Actions whose block is ``{column: spec}``, or that under ``columns``."""

    columns: dict[str, Any]

    @classmethod
    def from_block(cls, block: Any) -> Transform:
        if not isinstance(block, dict):
            raise TransformError(f"a mapping of columns is needed, not {block!r}")
        return cls.model_validate(block if set(block) == {"columns"} and isinstance(block["columns"], dict) else {"columns": block})


def build_transform(action: str, params: Any = None) -> Transform:
    """The action of a name with its validated parameters."""
    try:
        kind = TRANSFORMS.get(action)
    except RegistryError as e:
        raise TransformError(str(e)) from None
    try:
        return kind.from_block({} if params is None else params)
    except ValidationError as e:
        what = "; ".join(f"{'.'.join(map(str, x['loc']))}: {x['msg']}" for x in e.errors())
        raise TransformError(f"{action}: {what}") from e


def frame_of(operand: Any, flowing: DataFrame | None, ctx: Any) -> DataFrame:
    """The frame that an operand names: the flowing one or one of the state."""
    if isinstance(operand, DataFrame):
        return operand
    if is_pipe(operand):
        if flowing is None:
            raise TransformError("${pipe} is used, but no frame flows into the step")
        return flowing
    if ctx is None:
        raise TransformError(f"frame {operand!r} is used without a context")
    try:
        return ctx.state.get(operand)
    except StateError as e:
        raise TransformError(str(e)) from e
