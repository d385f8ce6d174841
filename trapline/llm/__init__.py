"""Operations on training text: filters, searches, duplicates, mixing and scoring. Nothing else in the library imports this."""
