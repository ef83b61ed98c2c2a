"""Multi-step work: schema mapping, industry classification, people filters, evaluation."""
