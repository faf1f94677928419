"""All catalogued queries."""

from plumbline.catalog import columns, daily, files, geography, kinds, modelling, relations, reports, texts

MODULES = [files, columns, kinds, relations, daily, geography, texts, modelling, reports]
QUERIES = {query.name: query for module in MODULES for query in module.QUERIES}
