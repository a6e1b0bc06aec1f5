"""The mention table: the contract between all stages."""

from __future__ import annotations

from pyspark.sql import types as T

MENTION = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("mention_id", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("law", T.StringType()),
        T.StructField("article", T.StringType()),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("implicit", T.BooleanType()),
        T.StructField("start", T.IntegerType()),
    ]
)

#: One topic document as the study platform stores it.
TOPIC = T.StructType(
    [
        T.StructField(
            "document",
            T.StructType(
                [
                    T.StructField(
                        "documentVersion",
                        T.StructType([T.StructField("contenido", T.StringType())]),
                    )
                ]
            ),
        )
    ]
)

#: One external response: the mentions a hosted extractor returned for a request.
RESPONSE = T.StructType(
    [
        T.StructField(
            "referencias",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("texto_completo", T.StringType()),
                        T.StructField("tipo", T.StringType()),
                        T.StructField("ley", T.StringType()),
                        T.StructField("articulo", T.StringType()),
                        T.StructField("confianza", T.IntegerType()),
                    ]
                )
            ),
        )
    ]
)
