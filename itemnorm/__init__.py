"""Item-name cleaning and consolidation on Spark DataFrames."""

from itemnorm.session import build_session, configure
from itemnorm.model import Catalogue, Memory

__all__ = ["Catalogue", "Memory", "build_session", "configure"]
