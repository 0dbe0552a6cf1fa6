"""Sources: contract, risk-factor and time-spec text (S1-S5), and the fixture
book derived from the driver's tables."""
