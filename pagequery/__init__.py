"""Declarative extraction from web pages and text, compiled to Spark plans."""

from .config import Config, ConfigError, load_config
from .api import Engine, ScrapeResult, backend_info, capabilities, extract, run_offline, scrape, scrape_file, version
from .sinks import export_records

__all__ = ["Config", "ConfigError", "Engine", "ScrapeResult", "backend_info", "capabilities", "export_records", "extract", "load_config", "run_offline", "scrape", "scrape_file", "version"]
