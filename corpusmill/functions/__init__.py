"""Column functions and the few row generators that need Python."""
