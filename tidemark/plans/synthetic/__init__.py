"""Every operator over the synthetic tables, each with the SQL that must give the same rows."""

from tidemark.plans.synthetic import (  # noqa: F401
    histories,
    hosts,
    intakes,
    storing,
    streams,
    tenants,
    uploading,
    visiting,
)
from tidemark.plans.synthetic.registry import ORACLES, QUERIES  # noqa: F401
