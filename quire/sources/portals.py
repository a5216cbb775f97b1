"""The source-portal dimension.

A handful of rows, fixed at code level, so broadcasting it is safe at any data scale.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the original portal configuration):
# portal name, earliest publication date served, portal domain.
PORTALS = [
    ("sp_sao_jose_dos_campos", dt.date(2022, 8, 15), "https://diariodomunicipio.sjc.sp.gov.br"),
    ("rj_rio_de_janeiro", dt.date(2012, 5, 29), "https://doweb.rio.rj.gov.br"),
    ("es_associacao_municipios", dt.date(2021, 1, 2), "https://ioes.dio.es.gov.br"),
    ("ro_jaru", dt.date(2022, 1, 1), "https://doe.jaru.ro.gov.br"),
    ("ms_corumba", dt.date(2012, 6, 26), "https://do.corumba.ms.gov.br"),
]
# URL path templates of the portal platform (fixed values).
METADATA_PATH = "/apifront/portal/edicoes/edicoes_from_data/"   # + yyyy-MM-dd + ".json"
STRUCTURE_PATH = "/portal/visualizacoes/view_html_diario/"     # + edition id
CONTENT_PATH = "/apifront/portal/edicoes/publicacoes_ver_conteudo/"  # + article identifier
PDF_PATH = "/apifront/portal/edicoes/pdf_diario/"              # + edition id + "/"
# The original parser always builds PDF links on this one host (compat mode).
COMPAT_PDF_HOST = "https://diariodomunicipio.sjc.sp.gov.br"
# ---------------------------------------------------------------------------

PORTAL_SCHEMA = T.StructType([
    T.StructField("portal_key", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("default_start_date", T.DateType(), False),
    T.StructField("domain_url", T.StringType(), False),
])


def portals(spark: SparkSession) -> DataFrame:
    """The portal dimension; ``portal_key`` is the 0-based position in ``PORTALS``."""
    rows = [(i, n, d, u) for i, (n, d, u) in enumerate(PORTALS)]
    return F.broadcast(spark.createDataFrame(rows, PORTAL_SCHEMA))
