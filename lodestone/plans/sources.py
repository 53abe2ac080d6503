"""The tables that are indexed by the registered queries, and the searches over them."""

from __future__ import annotations

from dataclasses import dataclass


class Fields(dict):
    """Field names and types, usable as part of a key."""

    def __hash__(self) -> int:
        return hash(tuple(self.items()))


@dataclass(frozen=True)
class Source:
    table: str
    key: str
    fields: Fields
    latest: str | None = None  # of several rows of a key the one with the greatest value here counts


DOCUMENTS = Source("documents", "doc_id", Fields(text="Text", lang="Keyword", source="Keyword", n_chars="Number"))
PARTS = Source("part", "p_partkey", Fields(p_name="Text", p_brand="Keyword", p_type="Keyword", p_size="Number", p_retailprice="Number"))
PRODUCTS = Source("products", "doc_id", Fields(title="Text", category="Keyword", organic="Bool", price="Number"), "arrived_at")
CONTACTS = Source("customer", "c_custkey", Fields(c_name="Text", c_mktsegment="Keyword"))

PRODUCT_QUERIES = ["frisch 500", "friscch", "Kümmelpaste", "trockenwaren", "ostrival", "g", "feinkots 250g"]

SEARCHES = {
    "search_exact_single": (PARTS, ["widget"]),
    "search_exact_and": (DOCUMENTS, ["winter ferry", "the village river"]),
    "search_duplicate_terms": (PARTS, ["red red", "red"]),
    "search_multi_field": (PARTS, ["small"]),
    "search_keyword": (PARTS, ["economy"]),
    "search_cross_field_no_match": (PARTS, ["red economy", "red widget"]),
    "search_empty_query": (PARTS, ["", " -,- ", "blue"]),
    "search_batch": (DOCUMENTS, ["winter", "ferry ledger", "a a the", "en", "de", "orchard meadow mill", "nothinglikethis", "pazasel test"]),
    "search_top100_ties": (PARTS, ["red", "bolt"]),
    "search_products": (PRODUCTS, PRODUCT_QUERIES),
    "search_customers": (CONTACTS, ["building", "customer 000000001"]),
}
FUZZY = {
    "search_fuzzy_first": (PARTS, ["smal widgett", "econmy", "red"], "first"),
    "search_fuzzy_full": (PARTS, ["smal widgett", "econmy", "rong"], "full"),
    "search_fuzzy_short_token": (PARTS, ["re", "wi bo", "red"], "full"),
    "search_fuzzy_products_first": (PRODUCTS, PRODUCT_QUERIES, "first"),
    "search_fuzzy_products_full": (PRODUCTS, PRODUCT_QUERIES, "full"),
    "search_fuzzy_documents_full": (DOCUMENTS, ["wintr fery", "vilage"], "full"),
}
