"""Plan fragments that keep work spread out when keys are not."""
