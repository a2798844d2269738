"""The default price plans and meter catalog."""

# Plan prices in cents (AUD), tenant plans, meters and their aggregation.
PRICE_PLANS = {
    "standard": {
        "version": 1,
        "currency": "AUD",
        "meters": {
            "llm.tokens.input": {
                "type": "TIERED",
                "tiers": [
                    {"up_to": 1000000, "unit_price_minor": 30, "per_units": 1000},
                    {"up_to": None, "unit_price_minor": 20, "per_units": 1000},
                ],
            },
            "llm.tokens.output": {
                "type": "TIERED",
                "tiers": [
                    {"up_to": 1000000, "unit_price_minor": 60, "per_units": 1000},
                    {"up_to": None, "unit_price_minor": 45, "per_units": 1000},
                ],
            },
            "llm.requests": {
                "type": "FLAT",
                "tiers": [{"up_to": None, "unit_price_minor": 5, "per_units": 1}],
            },
            "storage.gb": {
                "type": "FLAT",
                "tiers": [{"up_to": None, "unit_price_minor": 10, "per_units": 1}],
            },
        },
    },
    "growth": {
        "version": 1,
        "currency": "AUD",
        "meters": {
            "llm.tokens.input": {
                "type": "VOLUME",
                "tiers": [
                    {"up_to": 1000000, "unit_price_minor": 25, "per_units": 1000},
                    {"up_to": None, "unit_price_minor": 15, "per_units": 1000},
                ],
            },
            "llm.tokens.output": {
                "type": "VOLUME",
                "tiers": [
                    {"up_to": 1000000, "unit_price_minor": 50, "per_units": 1000},
                    {"up_to": None, "unit_price_minor": 35, "per_units": 1000},
                ],
            },
            "llm.requests": {
                "type": "FLAT",
                "tiers": [{"up_to": None, "unit_price_minor": 4, "per_units": 1}],
            },
            "storage.gb": {
                "type": "FLAT",
                "tiers": [{"up_to": None, "unit_price_minor": 8, "per_units": 1}],
            },
        },
    },
}

TENANT_PLANS = {
    "11111111-1111-1111-1111-111111111111": "standard",
    "22222222-2222-2222-2222-222222222222": "growth",
    "33333333-3333-3333-3333-333333333333": "standard",
}

TENANT_NAMES = {
    "11111111-1111-1111-1111-111111111111": "Acme",
    "22222222-2222-2222-2222-222222222222": "Globex",
    "33333333-3333-3333-3333-333333333333": "Initech",
}

METERS = {
    "llm.tokens.input": "SUM",
    "llm.tokens.output": "SUM",
    "llm.requests": "COUNT",
    "storage.gb": "SUM",
}
