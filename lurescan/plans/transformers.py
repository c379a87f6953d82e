"""Feature extraction as stages of an ML pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from .. import dims
from ..operators.features import extract, v1_features, with_features
from ..operators.lookalike_join import with_findings


class _Features(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds one double per feature to a table of URLs; ``VectorAssembler`` makes a vector of them.

    ``inputCol`` is the URL, ``names`` the features wanted (all by default). The stage keeps no fitted state, so
    it is saved and loaded with the pipeline that it is part of.
    """

    ALL: tuple[str, ...] = ()
    names = Param(Params._dummy(), "names", "the features to add", typeConverter=TypeConverters.toListString)

    def getNames(self) -> list[str]:
        return self.getOrDefault(self.names)

    def _start(self, given: dict) -> None:
        self._setDefault(inputCol="url", names=list(self.ALL))
        self._set(**given)
        unknown = set(self.getNames()) - set(self.ALL)
        if unknown:
            raise ValueError(f"no such features: {', '.join(sorted(unknown))}")


class URLFeatures(_Features):
    """The 41 features of the second generation. ``perHost`` works host features out once per distinct host."""

    ALL = tuple(dims.FEATURES)
    perHost = Param(Params._dummy(), "perHost", "work host features out once per distinct host", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol: str = "url", names: list[str] | None = None, perHost: bool = False):
        super().__init__()
        self._setDefault(perHost=False)
        self._start({k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        url, names = self.getInputCol(), self.getNames()
        if not self.getOrDefault(self.perHost) or dataset.isStreaming:
            return extract(dataset, url, names)
        found = with_findings(dataset, similarity="brand_similarity" in names, url=url)
        return with_features(found, url, names).select(*dataset.columns, *names)


class V1Features(_Features):
    """The 13 features of the first generation, of the raw URL."""

    ALL = tuple(dims.V1_FEATURES)

    @keyword_only
    def __init__(self, *, inputCol: str = "url", names: list[str] | None = None):
        super().__init__()
        self._start({k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return v1_features(dataset, self.getInputCol(), self.getNames()).select(*dataset.columns, *self.getNames())
